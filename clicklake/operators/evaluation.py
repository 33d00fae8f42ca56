"""Ranking metrics per impression, beyond-accuracy measures, calibration and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.features import popularity
from clicklake.operators.lists import UNIFORM_SQL, uniform
from clicklake.operators.windows import midrank
from clicklake.sources.logs import CLICKS, CUTOFF, PAIRS, articles, at, clicks, impressions, pair_table
from clicklake.sources.tables import table


def tie_ranked(scored: DataFrame, seed: int = 17) -> DataFrame:
    """Adds `rank`, 1 for the highest score of the impression; equal scores fall by a hash of (imp, article), then position.

    The order depends on the ids alone, never on where rows lie or what a model did to the list's order.
    """
    scored = scored.withColumn("_u", uniform(F.col("imp"), F.col("article_idx"), seed))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("imp").orderBy(F.desc("score"), F.desc("_u"), "position"))).drop("_u")


def rank_metrics(scored: DataFrame, ks: tuple[int, ...] = (5, 10), empty: str = "null") -> DataFrame:
    """Per impression: n, n_pos, auc, mrr (over every clicked item), mrr_first, ndcg@k and hit@k.

    `scored` has imp, article_idx, position, label, score, nulls in score sorting last. AUC ranks ties at their middle and is
    null where one class is missing. Without a click ndcg and mrr_first are 0; mrr and hit are null, or 0 under empty="zero".
    """
    scored = tie_ranked(scored).withColumn("mid", midrank(F.col("score"), "imp"))
    gain = lambda k: F.sum(F.when(F.col("label") & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    hits = lambda k: F.count_if(F.col("label") & (F.col("rank") <= k))
    sums = scored.groupBy("imp").agg(
        F.count("*").alias("n"), F.count_if("label").alias("n_pos"), F.sum(F.when(F.col("label"), F.col("mid"))).alias("mids"), F.sum(F.when(F.col("label"), 1 / F.col("rank"))).alias("inverse"),
        F.min(F.when(F.col("label"), F.col("rank"))).alias("first"), *(gain(k).alias(f"dcg{k}") for k in ks), *(hits(k).alias(f"hits{k}") for k in ks))
    p, n = F.col("n_pos"), F.col("n")
    none = F.lit(0.0) if empty == "zero" else F.lit(None).cast("double")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(p, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    auc = F.when((p > 0) & (p < n), (F.col("mids") - p * (p + 1) / 2) / (p * (n - p)))
    return sums.select(
        "imp", "n", "n_pos", auc.alias("auc"), F.when(p > 0, F.col("inverse") / p).otherwise(none).alias("mrr"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr_first"), F.col("first").alias("first_rank"),
        *(F.when(p > 0, F.col(f"dcg{k}") / ideal(k)).otherwise(0.0).alias(f"ndcg_{k}") for k in ks), *(F.when(p > 0, F.col(f"hits{k}") / p).otherwise(none).alias(f"hit_{k}") for k in ks))


def bootstrap(values: DataFrame, unit: str, value: str, replicates: int = 200, seed: int = 5, level: float = 0.95) -> DataFrame:
    """(mean, low, high, n): a percentile interval of the mean by the Poisson bootstrap; null and NaN values are left out.

    Every unit gets a Poisson(1) weight for each replicate from a hash of (unit, replicate): no resample is drawn, so the
    rows are read once and combined before the shuffle, and the interval is the same on any partitioning.
    """
    rows = values.select(F.col(unit).cast("bigint").alias("u"), F.col(value).cast("double").alias("v")).where("u is not null and v is not null and not isnan(v)")
    reps = rows.select("u", "v", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    u = F.pmod(F.xxhash64("u", "b", F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    cuts, total, p = [], 0.0, 0.36787944117144233
    for k in range(12):
        total += p
        cuts.append(total)
        p /= k + 1
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    means = reps.withColumn("w", weight).groupBy("b").agg(F.try_divide(F.sum(F.col("w") * F.col("v")), F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    spread = means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high"), F.avg((F.col("m") > 0).cast("double")).alias("share_above_0"))
    return rows.agg(F.avg("v").alias("mean"), F.count("*").alias("n")).crossJoin(spread)


def paired_bootstrap(a: DataFrame, b: DataFrame, unit: str, value: str, **how) -> DataFrame:
    """Interval of mean(b - a) over the units both have a value for, and whether it leaves out 0."""
    both = a.select(unit, F.col(value).alias("x")).join(b.select(unit, F.col(value).alias("y")), unit).select(unit, (F.col("y") - F.col("x")).alias("d"))
    out = bootstrap(both, unit, "d", **how)
    return out.select(F.col("mean").alias("diff"), "low", "high", F.col("share_above_0").alias("p_better"), ((F.col("low") > 0) | (F.col("high") < 0)).alias("excludes_zero"), "n")


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, rate): logistic scores in bins of equal width, the last one closed."""
    p = 1 / (1 + F.exp(-F.col("score")))
    rows = scored.select(p.alias("p"), F.col("label").cast("double").alias("y")).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int"))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"))


def calibration_summary(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(ece, brier, base_rate, n) over all rows."""
    by = calibration(scored, bins)
    n = F.sum("n")
    mean = lambda c: F.sum(F.col("n") * c) / n
    return by.agg(mean(F.abs(F.col("mean_p") - F.col("rate"))).alias("ece"), mean(F.col("brier")).alias("brier"), mean(F.col("rate")).alias("base_rate"), n.alias("n"))


def novelty(lists: DataFrame, shares: DataFrame) -> DataFrame:
    """(imp, novelty): the mean of -log2 of the articles' prior click share, floored at 1e-12; unknown articles have the floor."""
    p = F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(1e-12))
    return lists.join(shares, "article_idx", "left").groupBy("imp").agg(F.avg(-F.log2(p)).alias("novelty"))


def coverage(lists: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(recommended, catalogue, coverage): distinct articles in the lists over those of the catalogue."""
    n = catalogue.agg(F.count_distinct("idx").alias("catalogue"))
    return lists.agg(F.count_distinct("article_idx").alias("recommended")).crossJoin(F.broadcast(n)).withColumn("coverage", F.col("recommended") / F.greatest("catalogue", F.lit(1)))


def list_diversity(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(imp, ild): 1 less the mean cosine of all pairs of a list's items with a vector; null under two of them.

    With unit vectors the mean over pairs is (|sum|^2 - n) / (n (n - 1)), so a list of n items takes n steps, not n^2. The
    vectors are added per dimension, which combines before the shuffle.
    """
    length = F.greatest(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, y: a + y * y)), F.lit(1e-12))
    unit = vectors.select("article_idx", F.transform(F.array(length), lambda n: F.transform("vector", lambda x: x / n))[0].alias("unit"))
    opened = lists.select("imp", "article_idx").join(unit, "article_idx").select("imp", F.posexplode("unit").alias("d", "x"))
    sums = opened.groupBy("imp", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = sums.groupBy("imp").agg(F.sum(F.col("s") * F.col("s")).alias("all"), F.sum("q").alias("own"), F.max("n").alias("n"))
    return whole.select("imp", F.when(F.col("n") > 1, 1 - (F.col("all") - F.col("own")) / (F.col("n") * (F.col("n") - 1))).alias("ild"))


# queries: the test split's impressions ranked by clicks before it


def popular_scores(spark: SparkSession, folder: str) -> DataFrame:
    imp = impressions(spark, folder)
    old = popularity(clicks(imp).where(F.col("ts") < at(CUTOFF))).select("article_idx", F.col("clicks").alias("score"))
    shown = pair_table(imp.where(F.col("time") >= at(CUTOFF)))
    return shown.join(old, "article_idx", "left").withColumn("score", F.coalesce("score", F.lit(0)).cast("double"))


def position_scores(spark: SparkSession, folder: str) -> DataFrame:
    return pair_table(impressions(spark, folder, F.col("time") >= at(CUTOFF))).withColumn("score", -F.col("position").cast("double"))


METRICS = ("auc", "mrr", "mrr_first", "ndcg_5", "ndcg_10", "hit_5", "hit_10")


def _r(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def rank_metrics_q(spark, folder):
    return _r(rank_metrics(popular_scores(spark, folder)).drop("first_rank"), *METRICS)


def auc_q(spark, folder):
    return _r(rank_metrics(popular_scores(spark, folder)).select("imp", "auc"), "auc", digits=9)


def summarise_q(spark, folder):
    got = rank_metrics(popular_scores(spark, folder), empty="zero")
    return got.agg(F.count("*").alias("impressions"), *(F.round(F.avg(c), 6).alias(c) for c in METRICS))


def slices_q(spark, folder):
    """Means for cold and warm users by length of history, under 5 being cold."""
    users = table(spark, folder, "user_history").groupBy("user_idx").agg(F.max("n_hist").alias("n_hist"))
    users = impressions(spark, folder).select(F.col("src_row").alias("imp"), "user_idx").join(users, "user_idx", "left")
    got = rank_metrics(popular_scores(spark, folder)).join(users, "imp").withColumn("slice", F.when(F.coalesce("n_hist", F.lit(0)) < 5, "cold").otherwise("warm"))
    return got.groupBy("slice").agg(F.count("*").alias("impressions"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("ndcg_10"), 6).alias("ndcg_10"))


def head_tail_q(spark, folder):
    """Impressions by whether their clicked articles' clicks before the cutoff reach the 0.8 quantile."""
    old = popularity(clicks(impressions(spark, folder)).where(F.col("ts") < at(CUTOFF)))
    cut_at = old.agg(F.percentile("clicks", F.lit(0.8)).alias("cut"))
    clicked = popular_scores(spark, folder).where("label").crossJoin(F.broadcast(cut_at)).groupBy("imp").agg(F.max(F.col("score") >= F.col("cut")).alias("head"))
    got = rank_metrics(popular_scores(spark, folder)).join(clicked, "imp")
    return got.groupBy("head").agg(F.count("*").alias("impressions"), F.round(F.avg("auc"), 6).alias("auc"))


def histogram_q(spark, folder):
    got = rank_metrics(popular_scores(spark, folder)).where("first_rank is not null")
    return got.groupBy(F.least("first_rank", F.lit(11)).alias("rank")).agg(F.count("*").alias("n"))


def quantile_q(spark, folder):
    rows = table(spark, folder, "topk_scores").where("score is not null and not isnan(score)")
    return rows.groupBy("retriever").agg(*(F.round(F.percentile("score", F.lit(q)), 6).alias(f"p{int(100 * q)}") for q in (0.1, 0.5, 0.8, 0.95)))


def top_n_report_q(spark, folder):
    shown = pair_table(impressions(spark, folder)).groupBy("article_idx").agg(F.count("*").alias("n"))
    return shown.orderBy(F.desc("n"), "article_idx").limit(20)


def calibration_q(spark, folder):
    rows = popular_scores(spark, folder).withColumn("score", F.col("score") / 20 - 2)
    return _r(calibration(rows), "mean_p", "rate", "brier")


def calibration_summary_q(spark, folder):
    rows = popular_scores(spark, folder).withColumn("score", F.col("score") / 20 - 2)
    return _r(calibration_summary(rows), "ece", "brier", "base_rate")


def _top_lists(spark, folder):
    return tie_ranked(popular_scores(spark, folder)).where("rank <= 10")


def novelty_q(spark, folder):
    old = popularity(clicks(impressions(spark, folder)).where(F.col("ts") < at(CUTOFF)))
    total = old.agg(F.sum("clicks").alias("all"))
    shares = old.crossJoin(F.broadcast(total)).select("article_idx", (F.col("clicks") / F.col("all")).alias("share"))
    return _r(novelty(_top_lists(spark, folder), shares), "novelty")


def coverage_q(spark, folder):
    return _r(coverage(_top_lists(spark, folder), articles(spark, folder)), "coverage")


def ild_q(spark, folder):
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("article_idx"), F.col("embedding").cast("array<double>").alias("vector"))
    return _r(list_diversity(_top_lists(spark, folder), vectors), "ild")


def pop_oracle_q(spark, folder):
    """The leaky control: scores are the clicks within the very split."""
    imp = impressions(spark, folder, F.col("time") >= at(CUTOFF))
    inside = popularity(clicks(imp)).select("article_idx", F.col("clicks").cast("double").alias("score"))
    scored = pair_table(imp).join(inside, "article_idx", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return rank_metrics(scored).agg(F.count("*").alias("impressions"), F.round(F.avg("auc"), 6).alias("auc"), F.round(F.avg("mrr_first"), 6).alias("mrr_first"))


def bootstrap_q(spark, folder):
    return _r(bootstrap(rank_metrics(popular_scores(spark, folder)), "imp", "auc"), "mean", "low", "high", "share_above_0")


def paired_bootstrap_q(spark, folder):
    a, b = rank_metrics(position_scores(spark, folder)), rank_metrics(popular_scores(spark, folder))
    return _r(paired_bootstrap(a, b, "imp", "auc"), "diff", "low", "high", "p_better")


def join_paired_q(spark, folder):
    a, b = rank_metrics(position_scores(spark, folder)), rank_metrics(popular_scores(spark, folder))
    return a.select("imp", F.col("auc").alias("x")).join(b.select("imp", F.col("auc").alias("y")), "imp").where("x is not null and y is not null").select("imp", F.round(F.col("y") - F.col("x"), 9).alias("diff"))


QUERIES = {
    "rank_metrics": rank_metrics_q, "auc": auc_q, "summarise": summarise_q, "slices": slices_q, "head_tail": head_tail_q, "histogram": histogram_q, "quantile": quantile_q, "top_n_report": top_n_report_q, "calibration": calibration_q,
    "calibration_summary": calibration_summary_q, "novelty": novelty_q, "coverage": coverage_q, "ild": ild_q, "pop_oracle": pop_oracle_q, "bootstrap": bootstrap_q, "paired_bootstrap": paired_bootstrap_q, "join_paired": join_paired_q,
}

_U = UNIFORM_SQL.format(a="imp", b="article_idx", seed=17)
_SCORED = f"""WITH {CLICKS}, opened AS (SELECT src_row AS imp, user_idx, len(candidates) AS n_candidates, unnest(candidates) AS article_idx, unnest(range(len(candidates))) AS position, coalesce(clicked, []) AS clicked FROM imp WHERE time >= TIMESTAMP '{CUTOFF}'),
old AS (SELECT article_idx, count(*) AS clicks FROM clicks WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY 1),
sc AS (SELECT imp, user_idx, o.article_idx, position, coalesce(list_contains(clicked, o.article_idx), false) AS label, coalesce(clicks, 0) AS score FROM opened o LEFT JOIN old ON old.article_idx = o.article_idx),
uu AS (SELECT *, {_U} AS u FROM sc),
rk AS (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY score DESC, u DESC, position) AS rank FROM uu)"""
_AUC = """, au AS (SELECT a.imp, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM rk a JOIN rk b ON a.imp = b.imp AND a.label AND NOT b.label GROUP BY 1)"""
_M = (
    _SCORED
    + _AUC
    + """, g AS (SELECT imp, any_value(user_idx) AS user_idx, count(*) AS n, count(*) FILTER (label) AS n_pos, sum(1.0 / rank) FILTER (label) AS inv, min(rank) FILTER (label) AS first,
 sum(1 / log2(rank + 1)) FILTER (label AND rank <= 5) AS d5, sum(1 / log2(rank + 1)) FILTER (label AND rank <= 10) AS d10, count(*) FILTER (label AND rank <= 5) AS h5, count(*) FILTER (label AND rank <= 10) AS h10 FROM rk GROUP BY 1),
ideal AS (SELECT p, sum(1 / log2(i + 1)) FILTER (i <= 5) AS i5, sum(1 / log2(i + 1)) FILTER (i <= 10) AS i10 FROM range(1, 60) a(p), range(1, 60) b(i) WHERE i <= p GROUP BY 1),
m AS (SELECT g.imp, user_idx, n, n_pos, first, auc, inv / n_pos AS mrr, coalesce(1.0 / first, 0) AS mrr_first, coalesce(d5, 0) / coalesce(i5, 1) AS ndcg_5, coalesce(d10, 0) / coalesce(i10, 1) AS ndcg_10,
 h5 / nullif(n_pos, 0) AS hit_5, h10 / nullif(n_pos, 0) AS hit_10 FROM g LEFT JOIN au ON au.imp = g.imp LEFT JOIN ideal ON p = n_pos)"""
)
_TOP = ", top AS (SELECT * FROM rk WHERE rank <= 10)"
_CAL = ", pr AS (SELECT 1 / (1 + exp(-(score / 20.0 - 2))) AS p, CAST(label AS INT) AS y FROM sc), bins AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS rate, avg((p - y) * (p - y)) AS brier FROM pr GROUP BY 1)"

ORACLES = {
    "rank_metrics": _M + " SELECT imp, n, n_pos, round(auc, 6) AS auc, round(mrr, 6) AS mrr, round(mrr_first, 6) AS mrr_first, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10, round(hit_5, 6) AS hit_5, round(hit_10, 6) AS hit_10 FROM m",
    "auc": _SCORED + _AUC + " SELECT i.imp, round(auc, 9) AS auc FROM (SELECT DISTINCT imp FROM rk) i LEFT JOIN au ON au.imp = i.imp",
    "summarise": _M + " SELECT count(*) AS impressions, round(avg(auc), 6) AS auc, round(avg(coalesce(mrr, 0)), 6) AS mrr, round(avg(mrr_first), 6) AS mrr_first, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(coalesce(hit_5, 0)), 6) AS hit_5, round(avg(coalesce(hit_10, 0)), 6) AS hit_10 FROM m",
    "slices": _M + ", uh AS (SELECT user_idx, max(n_hist) AS n_hist FROM user_history GROUP BY 1) SELECT CASE WHEN coalesce(n_hist, 0) < 5 THEN 'cold' ELSE 'warm' END AS slice, count(*) AS impressions, round(avg(auc), 6) AS auc, round(avg(ndcg_10), 6) AS ndcg_10 FROM m LEFT JOIN uh ON uh.user_idx = m.user_idx GROUP BY 1",
    "head_tail": _M + ", q AS (SELECT quantile_cont(clicks, 0.8) AS cut FROM old), hd AS (SELECT imp, bool_or(score >= cut) AS head FROM sc, q WHERE label GROUP BY 1) SELECT head, count(*) AS impressions, round(avg(auc), 6) AS auc FROM m JOIN hd ON hd.imp = m.imp GROUP BY 1",
    "histogram": _M + " SELECT CAST(least(first, 11) AS INT) AS rank, count(*) AS n FROM m WHERE first IS NOT NULL GROUP BY 1",
    "quantile": "SELECT retriever, round(quantile_cont(score, 0.1), 6) AS p10, round(quantile_cont(score, 0.5), 6) AS p50, round(quantile_cont(score, 0.8), 6) AS p80, round(quantile_cont(score, 0.95), 6) AS p95 FROM topk_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1",
    "top_n_report": f"WITH {PAIRS} SELECT article_idx, count(*) AS n FROM pairs GROUP BY 1 ORDER BY n DESC, article_idx LIMIT 20",
    "calibration": _SCORED + _CAL + " SELECT bin, n, round(mean_p, 6) AS mean_p, round(rate, 6) AS rate, round(brier, 6) AS brier FROM bins",
    "calibration_summary": _SCORED + _CAL + " SELECT round(sum(n * abs(mean_p - rate)) / sum(n), 6) AS ece, round(sum(n * brier) / sum(n), 6) AS brier, round(sum(n * rate) / sum(n), 6) AS base_rate, CAST(sum(n) AS BIGINT) AS n FROM bins",
    "novelty": _SCORED + _TOP + " SELECT imp, round(avg(-log2(greatest(coalesce(clicks / (SELECT sum(clicks) FROM old), 0), 1e-12))), 6) AS novelty FROM top LEFT JOIN old ON old.article_idx = top.article_idx GROUP BY 1",
    "coverage": _SCORED + _TOP + ", n AS (SELECT count(DISTINCT idx) AS c FROM articles WHERE idx IS NOT NULL) SELECT count(DISTINCT article_idx) AS recommended, any_value(c) AS catalogue, round(count(DISTINCT article_idx) / any_value(c), 6) AS coverage FROM top, n",
    "ild": _SCORED + _TOP + """, tv AS (SELECT imp, row_number() OVER (PARTITION BY imp ORDER BY rank) AS i, CAST(embedding AS DOUBLE[]) AS v FROM top JOIN embeddings e ON e.vec_id = top.article_idx)
        SELECT a.imp, round(1 - avg(list_cosine_similarity(a.v, b.v)), 6) AS ild FROM tv a LEFT JOIN tv b ON a.imp = b.imp AND a.i < b.i GROUP BY 1""",
    "join_paired": _SCORED + _AUC + """, op AS (SELECT imp, position, coalesce(list_contains(clicked, article_idx), false) AS label FROM opened), ap AS (SELECT a.imp, avg(CASE WHEN a.position < b.position THEN 1.0 ELSE 0 END) AS x FROM op a JOIN op b ON a.imp = b.imp AND a.label AND NOT b.label GROUP BY 1)
        SELECT au.imp, round(auc - x, 9) AS diff FROM au JOIN ap ON ap.imp = au.imp""",
    "pop_oracle": f"""WITH {CLICKS}, opened AS (SELECT src_row AS imp, unnest(candidates) AS article_idx, unnest(range(len(candidates))) AS position, coalesce(clicked, []) AS clicked FROM imp WHERE time >= TIMESTAMP '{CUTOFF}'),
        old AS (SELECT article_idx, count(*) AS clicks FROM clicks WHERE ts >= TIMESTAMP '{CUTOFF}' GROUP BY 1),
        sc AS (SELECT imp, o.article_idx, position, coalesce(list_contains(clicked, o.article_idx), false) AS label, coalesce(clicks, 0) AS score FROM opened o LEFT JOIN old ON old.article_idx = o.article_idx),
        uu AS (SELECT *, {_U} AS u FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY score DESC, u DESC, position) AS rank FROM uu)""" + _AUC + """
        SELECT count(*) AS impressions, round(avg(auc), 6) AS auc, round(avg(f), 6) AS mrr_first FROM (SELECT imp, coalesce(1.0 / min(rank) FILTER (label), 0) AS f FROM rk GROUP BY 1) i LEFT JOIN au ON au.imp = i.imp""",
}
