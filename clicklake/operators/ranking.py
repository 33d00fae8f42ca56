"""The wide feature join, a linear fusion of features, and boosted trees over feature families."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.operators import trees
from clicklake.operators.evaluation import paired_bootstrap, rank_metrics
from clicklake.operators.features import ORACLES as _FEATURES
from clicklake.operators.features import article_features, category_profile, category_recency, exposures, history_recency, hours, user_features
from clicklake.operators.lexical import article_index, history_queries
from clicklake.operators.lists import UNIFORM_SQL, zscore_within
from clicklake.operators.matching import ORACLES as _MATCHING
from clicklake.operators.matching import matching_features
from clicklake.operators.vectors import _article_vectors
from clicklake.operators.windows import ORACLES as _WINDOWS
from clicklake.operators.windows import article_dwell, asof_before_all, dwell_features, rolling_article_stats, session_features
from clicklake.plans.cut import cut
from clicklake.sources.logs import ARTICLES, CUTOFF, PAIRS, VAL_FROM, articles, at, clicks, histories, impressions, pair_table

#: Families of feature columns; a run uses those of them that the table has. The names and their grouping.
FAMILIES = {
    "user": ("n_hist", "clicks_24h", "clicks_7d", "hours_since_last_click", "top_category_share", "n_categories", "category_entropy", "prior_read_time", "prior_scroll", "prior_impressions"),
    "article": ("ctr_smoothed", "clicks_decayed", "prior_clicks", "prior_inview", "age_hours", "roll_inview", "roll_age_hours"),
    "rolling": ("roll_clicks", "roll_ctr", "art_read_time", "art_dwell_n"),
    "match": ("bm25", "emb_cos", "emb_max", "emb_recent", "cat_share", "cat_clicks", "cat_recency", "cat_recency_share"),
    "context": ("session_rank", "session_seconds", "secs_since_prev", "device_type", "is_subscriber", "is_sso_user", "n_candidates"),
    "grey": ("read_time", "scroll_percentage", "position", "position_frac"),
}
#: What a server can know of lists without labels; with a live click log; and what the log knows only once the list was shown.
SHIPPED = ("user", "article", "match", "context")
PRODUCTION = (*SHIPPED, "rolling")
GREY = (*PRODUCTION, "grey")


def columns_of(df: DataFrame, families: tuple[str, ...]) -> list[str]:
    """The feature columns of the families that the table has, in their order."""
    return [c for f in families for c in FAMILIES[f] if c in df.columns]


def attach_features(shown: DataFrame, imp: DataFrame, history: DataFrame, article: DataFrame, match: DataFrame, cutoff: str) -> DataFrame:
    """Shown candidates (imp, user_idx, time, article_idx, position, label) with the features of every family.

    Counters of clicks, exposures and recency count what lies before `cutoff`, which is where the window of the candidates
    begins: a row's features never hold its own click, nor any of its window. Rolling counters, dwell and sessions are those
    strictly before the row. `match` has the matching signals by (user_idx, article_idx). Counters are read from all
    impressions, never from the candidates. Unknown categories, articles and pairs count 0; unknown users keep nulls.
    """
    click = clicks(imp)
    topic = article.select(F.col("idx").alias("article_idx"), "topic", F.coalesce("published_time", "first_seen_time").alias("born"))
    users = user_features(history, click, article, cutoff).drop("top_categories", "last_click")
    counts = article_features(click, exposures(imp.where(F.col("time") < at(cutoff))), cutoff).select("article_idx", "clicks_decayed", "ctr_smoothed", F.col("clicks").alias("prior_clicks"), F.col("n_inview").alias("prior_inview"))
    rolling = rolling_article_stats(pair_table(imp), article)
    out = asof_before_all(shown.select("imp", "user_idx", "time", "article_idx", "position", "label"), [(rolling, ["roll_inview", "roll_clicks", "roll_ctr", "roll_age_hours"]), (article_dwell(imp), ["art_read_time", "art_dwell_n"])], "article_idx", "time")
    # what the impression has: its own columns, and what its session and user had before it
    own = imp.select(F.col("src_row").alias("imp"), F.size("candidates").alias("n_candidates"), "device_type", "is_subscriber", "is_sso_user", F.col("read_time").cast("double").alias("read_time"), F.col("scroll_percentage").cast("double").alias("scroll_percentage"))
    own = own.join(session_features(imp), "imp", "left").join(dwell_features(imp), "imp", "left")
    # what the user and the article have
    profile = category_profile(history, article).join(category_recency(history_recency(history), article), ["user_idx", "topic"], "full")
    out = out.join(own, "imp", "left").join(topic.join(counts, "article_idx", "full"), "article_idx", "left").join(users, "user_idx", "left")
    out = out.join(profile, ["user_idx", "topic"], "left").join(match, ["user_idx", "article_idx"], "left")
    out = out.withColumn("age_hours", hours(F.col("born"), F.col("time"))).drop("born", "topic").withColumn("position_frac", F.col("position") / F.greatest(F.col("n_candidates") - 1, F.lit(1)))
    zero = ("clicks_decayed", "ctr_smoothed", "prior_clicks", "prior_inview", "cat_share", "cat_clicks", "cat_recency", "cat_recency_share", "roll_inview", "roll_clicks", "roll_ctr", "bm25", "emb_cos", "emb_max", "emb_recent")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def linear_fusion(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds `score`: the weighted sum of the features' z-scores within each impression; plain SQL, the same on any partitioning."""
    total = sum((w * F.round(zscore_within(features, "imp", c), 9) for c, w in weights.items()), F.lit(0.0))
    return features.withColumn("score", F.round(total, 9))


def sampled(features: DataFrame, names: list[str], impressions_most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, labels, impressions) of the rows of at most so many impressions, those of the smallest hashes of their ids; NaN for null."""
    chosen = features.select("imp").distinct().orderBy(F.xxhash64("imp"), "imp").limit(impressions_most)
    rows = features.join(F.broadcast(chosen), "imp").select("imp", F.col("label").cast("double").alias("label"), "position", *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names))).orderBy("imp", "position").toArrow()
    x = np.column_stack([rows[f"f{i}"].to_numpy() for i in range(len(names))]) if names else np.zeros((rows.num_rows, 0))
    return x.astype(float), rows["label"].to_numpy(), rows["imp"].to_numpy()


def fit_ranker(features: DataFrame, names: list[str], objective: str = "listwise", impressions_most: int = 20_000, **how) -> trees.Trees:
    """Boosted trees over the named columns for the order of clicks within impressions.

    `listwise` weighs pairs by their effect on nDCG, `pointwise` takes each row alone. Either is fitted on four fifths of at
    most `impressions_most` impressions and ends by the nDCG@10 of the last fifth, told apart by a hash of the impression.
    """
    x, y, imp = sampled(features, names, impressions_most)
    held = (imp.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0
    loss = trees.listwise(y[~held], imp[~held]) if objective == "listwise" else trees.logistic(y[~held])
    watch = (x[held], lambda f: trees.ndcg(f, y[held], imp[held])) if held.any() else None
    return trees.fit(x[~held], loss, watch=watch, **how)


def score_trees(model: trees.Trees, features: DataFrame, names: list[str]) -> DataFrame:
    """(imp, article_idx, position, label, score): blocks of rows through the model where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(4, b.num_columns)]) if b.num_columns > 4 else np.zeros((b.num_rows, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.round(model.score(x), 9))], ["imp", "article_idx", "position", "label", "score"])

    rows = features.select("imp", "article_idx", "position", "label", *(F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)))
    return rows.mapInArrow(run, "imp bigint, article_idx bigint, position int, label boolean, score double")


def importances(model: trees.Trees, names: list[str]) -> list[tuple[str, float]]:
    """Share of the gain of each feature."""
    total = max(float(model.gains.sum()), 1e-12)
    return [(n, float(g) / total) for n, g in zip(names, model.gains)]


# queries


def _features(spark: SparkSession, folder: str, since: str, until: str | None) -> DataFrame:
    """The shown candidates of the window from `since` to before `until`, with their features as of `since`."""
    imp = cut(impressions(spark, folder), "log")  # read many times, counted once
    own = imp.where(F.col("time") >= at(since))
    if until:
        own = own.where(F.col("time") < at(until))
    history, shown = histories(spark, folder), pair_table(own)
    i = article_index(spark, folder)
    match = matching_features(shown, history, _article_vectors(spark, folder), history_queries(history, i.postings), i.weights())
    return attach_features(shown, imp, history, articles(spark, folder), match, since)


#: Decimals of the feature columns in query results.
DIGITS = {"position_frac": 9, "art_read_time": 5, "prior_read_time": 5, "prior_scroll": 5, "bm25": 4, "emb_cos": 4, "emb_max": 4, "emb_recent": 4}


def _rounded(got: DataFrame) -> DataFrame:
    return got.withColumns({c: F.round(c, DIGITS.get(c, 6)) for c, t in got.dtypes if t == "double"}).drop("time")


def attach_features_q(spark, folder):
    """Every family's features of the test window, counted before it."""
    return _rounded(_features(spark, folder, CUTOFF, None))


def train_features_q(spark, folder):
    """The same of the validation window, on which rankers are fitted: nothing in or after the window is counted."""
    return _rounded(_features(spark, folder, VAL_FROM, CUTOFF))


WEIGHTS = {"roll_ctr": 1.0, "ctr_smoothed": 0.5, "cat_recency_share": 0.3, "art_read_time": 0.2}


def linear_fusion_q(spark, folder):
    """Ranking metrics of a weighted sum of z-scores."""
    got = linear_fusion(attach_features_q(spark, folder), WEIGHTS)
    return rank_metrics(got.select("imp", "article_idx", "position", "label", "score")).agg(F.count("*").alias("impressions"), *(F.round(F.avg(c), 4).alias(c) for c in ("auc", "mrr_first", "ndcg_10")))


def _split(spark, folder) -> tuple[DataFrame, DataFrame]:
    return cut(_features(spark, folder, VAL_FROM, CUTOFF), "train"), cut(_features(spark, folder, CUTOFF, None), "test")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def gbdt_ranker_q(spark, folder):
    """Trees fitted on the validation window, measured on test: the shipped, the production and the grey families, and both losses."""
    train, test = _split(spark, folder)
    every = []
    for name, families, objective in (("shipped", SHIPPED, "listwise"), ("shipped", SHIPPED, "pointwise"), ("production", PRODUCTION, "listwise"), ("grey", GREY, "listwise")):
        names = columns_of(train, families)
        model = fit_ranker(train, names, objective)
        every.append(rank_metrics(score_trees(model, test, names)).agg(F.lit(name).alias("families"), F.lit(objective).alias("objective"), F.lit(len(model.leaves)).alias("trees"), F.count("*").alias("impressions"), *(F.round(F.avg(c), 4).alias(c) for c in ("auc", "mrr_first", "ndcg_10"))))
    return _union(every)


def predict_blocks_q(spark, folder):
    """The shipped model's score of every candidate of the test window."""
    train, test = _split(spark, folder)
    names = columns_of(train, SHIPPED)
    return score_trees(fit_ranker(train, names), test, names)


def importances_q(spark, folder):
    """Share of the gain of each feature of the production families."""
    train = cut(_features(spark, folder, VAL_FROM, CUTOFF), "train")
    names = columns_of(train, PRODUCTION)
    got = spark.createDataFrame(importances(fit_ranker(train, names), names), "feature string, share double")
    return got.withColumn("share", F.round("share", 6))


def ablation_q(spark, folder):
    """AUC on test with each production family left out of the fit, and with the grey one added: the difference to all of production, and its paired interval."""
    train, test = _split(spark, folder)
    scored = {}
    for name, families in (("production", PRODUCTION), *((f"without {f}", tuple(x for x in PRODUCTION if x != f)) for f in PRODUCTION), ("with grey", GREY)):
        names = columns_of(train, families)
        scored[name] = cut(rank_metrics(score_trees(fit_ranker(train, names, rounds=40), test, names)).select("imp", "auc"), "auc")
    base = scored.pop("production")
    return _union([paired_bootstrap(base, own, "imp", "auc").select(F.lit(name).alias("run"), *(F.round(c, 4).alias(c) for c in ("diff", "low", "high")), "excludes_zero", "n") for name, own in scored.items()])


def feature_families_q(spark, folder):
    """Which columns of the wide join each named set of families has, in order."""
    columns = attach_features_q(spark, folder).columns
    have = [(name, place, c) for name, families in (("shipped", SHIPPED), ("production", PRODUCTION), ("grey", GREY)) for place, c in enumerate(c for f in families for c in FAMILIES[f] if c in columns)]
    return spark.createDataFrame(have, "families string, place int, feature string")


def coverage_profile_q(spark, folder):
    """Share of nulls and zeros and number of values of each feature, in one pass."""
    got = attach_features_q(spark, folder)
    names = columns_of(got, tuple(FAMILIES))
    stats = F.array(*(F.struct(F.lit(c).alias("feature"), F.round(F.avg(F.col(c).isNull().cast("double")), 6).alias("nulls"), F.round(F.avg(F.coalesce(F.col(c).cast("double") == 0, F.lit(False)).cast("double")), 6).alias("zeros")) for c in names))
    return got.agg(stats.alias("s")).select(F.inline("s"))


QUERIES = {
    "attach_features": attach_features_q, "train_features": train_features_q, "linear_fusion": linear_fusion_q, "gbdt_ranker": gbdt_ranker_q, "predict_blocks": predict_blocks_q, "importances": importances_q, "ablation": ablation_q,
    "feature_families": feature_families_q, "coverage_profile": coverage_profile_q,
}


def _attached(since: str, until: str | None) -> str:
    """The wide join of a window in SQL. The log ends with the window: nothing after it is there to be counted."""
    to = f"AND time < TIMESTAMP '{until}'" if until else ""
    log = f"WITH impressions AS (SELECT * FROM main.impressions WHERE {f"time < TIMESTAMP '{until}' OR time IS NULL" if until else "true"})"
    before = lambda sql: sql.replace(CUTOFF, since)
    return f"""{log}, b AS (WITH {PAIRS} SELECT * FROM pairs WHERE time >= TIMESTAMP '{since}' {to}), im AS (WITH {PAIRS} SELECT * FROM imp), sf AS ({_WINDOWS["session_features"]}), dw AS ({_WINDOWS["dwell_features"]}), st AS ({_WINDOWS["rolling_article_stats"]}), ad AS ({_WINDOWS["article_dwell"]}),
af AS ({before(_FEATURES["article_features"])}), uf AS ({before(_FEATURES["user_features"])}), cp AS ({_FEATURES["category_profile"]}), cr AS ({_FEATURES["category_recency"]}), a AS (WITH {ARTICLES} SELECT idx, topic, coalesce(published_time, first_seen_time) AS born FROM art),
mt AS ({_MATCHING["matching_features"]}),
b1 AS (SELECT b.*, roll_inview, roll_clicks, roll_ctr, roll_age_hours FROM b ASOF LEFT JOIN st ON b.article_idx = st.article_idx AND b.time > st.time), b2 AS (SELECT b1.*, art_read_time, art_dwell_n FROM b1 ASOF LEFT JOIN ad ON b1.article_idx = ad.article_idx AND b1.time > ad.time),
ft AS (SELECT b2.imp, b2.user_idx, b2.article_idx, CAST(b2.position AS INT) AS position, round(b2.position / greatest(b2.n_candidates - 1, 1), 9) AS position_frac, CAST(b2.n_candidates AS INT) AS n_candidates, label, coalesce(roll_inview, 0) AS roll_inview, coalesce(roll_clicks, 0) AS roll_clicks,
 coalesce(roll_ctr, 0) AS roll_ctr, roll_age_hours, art_read_time, art_dwell_n, session_rank, session_seconds, secs_since_prev, prior_read_time, prior_scroll, prior_impressions, coalesce(clicks_decayed, 0) AS clicks_decayed, coalesce(ctr_smoothed, 0) AS ctr_smoothed, coalesce(af.clicks, 0) AS prior_clicks,
 coalesce(af.n_inview, 0) AS prior_inview, n_hist, clicks_24h, clicks_7d, hours_since_last_click, top_category_share, n_categories, category_entropy, coalesce(cat_share, 0) AS cat_share, coalesce(cat_clicks, 0) AS cat_clicks, coalesce(cat_recency, 0) AS cat_recency,
 coalesce(cat_recency_share, 0) AS cat_recency_share, round(date_sub('second', born, b2.time) / 3600.0, 6) AS age_hours, coalesce(bm25, 0) AS bm25, coalesce(emb_cos, 0) AS emb_cos, coalesce(emb_recent, 0) AS emb_recent, coalesce(emb_max, 0) AS emb_max,
 im.device_type, im.is_subscriber, im.is_sso_user, round(CAST(im.read_time AS DOUBLE), 6) AS read_time, round(CAST(im.scroll_percentage AS DOUBLE), 6) AS scroll_percentage
 FROM b2 LEFT JOIN im ON im.src_row = b2.imp LEFT JOIN sf ON sf.imp = b2.imp LEFT JOIN dw ON dw.imp = b2.imp LEFT JOIN a ON a.idx = b2.article_idx LEFT JOIN af ON af.article_idx = b2.article_idx LEFT JOIN uf ON uf.user_idx = b2.user_idx
 LEFT JOIN cp ON cp.user_idx = b2.user_idx AND cp.topic = a.topic LEFT JOIN cr ON cr.user_idx = b2.user_idx AND cr.topic = a.topic LEFT JOIN mt ON mt.user_idx = b2.user_idx AND mt.article_idx = b2.article_idx)"""


_ATTACHED = _attached(CUTOFF, None)
_Z = ", ".join(f"coalesce(round((coalesce({c}, NULL) - avg({c}) OVER w) / coalesce(nullif(stddev_samp({c}) OVER w, 0), 1), 9), 0) AS z{i}" for i, c in enumerate(WEIGHTS))
_FUSED = _ATTACHED + f""", z AS (SELECT imp, article_idx, position, label, {_Z} FROM ft WINDOW w AS (PARTITION BY imp)), sc AS (SELECT imp, article_idx, position, label, round({" + ".join(f"{w} * z{i}" for i, w in enumerate(WEIGHTS.values()))}, 9) AS score FROM z),
uu AS (SELECT *, {UNIFORM_SQL.format(a="imp", b="article_idx", seed=17)} AS u FROM sc), rk AS (SELECT *, row_number() OVER (PARTITION BY imp ORDER BY score DESC, u DESC, position) AS rank FROM uu)"""

ORACLES = {
    "attach_features": _ATTACHED + " SELECT * FROM ft",
    "train_features": _attached(VAL_FROM, CUTOFF) + " SELECT * FROM ft",
    "feature_families": "SELECT families, CAST(place AS INT) AS place, feature FROM (" + " UNION ALL ".join(f"SELECT '{name}' AS families, i AS place, l[i + 1] AS feature FROM (SELECT {[c for f in families for c in FAMILIES[f]]} AS l), range(100) r(i) WHERE i < len(l)" for name, families in (("shipped", SHIPPED), ("production", PRODUCTION), ("grey", GREY))) + ")",
    "linear_fusion": _FUSED + """, au AS (SELECT a.imp, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM rk a JOIN rk b ON a.imp = b.imp AND a.label AND NOT b.label GROUP BY 1),
        g AS (SELECT imp, count(*) FILTER (label) AS p, min(rank) FILTER (label) AS first, sum(1 / log2(rank + 1)) FILTER (label AND rank <= 10) AS d FROM rk GROUP BY 1), il AS (SELECT p, sum(1 / log2(i + 1)) AS ideal FROM range(1, 60) a(p), range(1, 11) b(i) WHERE i <= p GROUP BY 1)
        SELECT count(*) AS impressions, round(avg(auc), 4) AS auc, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr_first, round(avg(coalesce(d, 0) / coalesce(ideal, 1)), 4) AS ndcg_10 FROM g LEFT JOIN au ON au.imp = g.imp LEFT JOIN il ON il.p = g.p""",
    "coverage_profile": _ATTACHED + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg(CAST({c} IS NULL AS INT)), 6) AS nulls, round(avg(CAST(coalesce({c} = 0, false) AS INT)), 6) AS zeros FROM ft" for f in FAMILIES for c in FAMILIES[f]),
}
