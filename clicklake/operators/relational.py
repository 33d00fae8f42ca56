"""Joins, orders, limits and set operations of the click log, each as one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.candidates import drop_seen, rrf, top_rows
from clicklake.operators.features import hours
from clicklake.operators.lexical import article_index, history_queries
from clicklake.operators.lists import UNIFORM_SQL, uniform
from clicklake.operators.postings import _P as _POSTINGS
from clicklake.sources.logs import ARTICLES, HISTORY, IMP, PAIRS, articles, clicks, histories, history_clicks, impressions, pair_table
from clicklake.sources.tables import table


def slot_chunks(df: DataFrame, order: str, slots: str, budget: int, span: int = 4096) -> DataFrame:
    """(order, slots, chunk): consecutive rows in chunks of at most about `budget` slots, one row at least each.

    The running sum is taken within spans of the order key and over the spans, so no task orders the whole table; a chunk is
    the running sum over the budget, so chunks hold at most the budget plus one row.
    """
    rows = df.select(F.col(order).alias("o"), F.col(slots).alias("s"), F.floor(F.col(order) / span).alias("span"))
    sums = rows.groupBy("span").agg(F.sum("s").alias("all"))
    before = F.coalesce(F.sum("all").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = sums.select("span", before.alias("before"))
    inside = rows.withColumn("sum", F.sum("s").over(W.partitionBy("span").orderBy("o").rowsBetween(W.unboundedPreceding, -1)))
    run = F.coalesce("sum", F.lit(0)) + F.col("before")
    return inside.join(shifts, "span").select(F.col("o").alias(order), F.col("s").alias(slots), F.floor(run / budget).alias("chunk"))


def topk_merge(scored: DataFrame, shard: str, k: int) -> DataFrame:
    """The k best rows a user over all shards from each shard's own k best: equal to ranking all at once."""
    local = scored.withColumn("r", F.row_number().over(W.partitionBy("user_idx", shard).orderBy(F.desc("score"), "article_idx"))).where(F.col("r") <= k).drop("r")
    return top_rows(local, k, F.desc("score"), F.col("article_idx"))


def shard_bounds(shards: int, skew: float) -> list[float]:
    """Upper ends in (0, 1] of shards whose sizes fall as 1 / rank^skew; equal ones for 0."""
    sizes = [1 / (i + 1) ** skew for i in range(shards)]
    return [round(sum(sizes[: i + 1]) / sum(sizes), 12) for i in range(shards)]


def shard_of(key: Column, bounds: list[float], seed: int = 41) -> Column:
    """The shard of an integer key by a hash of it alone."""
    u = uniform(key, F.lit(0), seed)
    return sum((F.when(u >= b, 1).otherwise(0) for b in bounds[:-1]), F.lit(0)).alias("shard")


def _best(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "topk_scores").where("user_idx is not null and article_idx is not null and score is not null and not isnan(score)")
    return rows.groupBy("user_idx", "article_idx").agg(F.max(F.col("score") + 0.0).alias("score"))


def join_left_ordered_q(spark, folder):
    cats = articles(spark, folder).select(F.col("idx").alias("article_idx"), "topic")
    return pair_table(impressions(spark, folder)).join(cats, "article_idx", "left").select("imp", "position", "topic")


def join_left_q(spark, folder):
    users = histories(spark, folder).select("user_idx", "n_hist")
    return impressions(spark, folder).join(users, "user_idx", "left").select("src_row", "user_idx", "n_hist")


def join_inner_q(spark, folder):
    cats = articles(spark, folder).select(F.col("idx").alias("article_idx"), "topic")
    return clicks(impressions(spark, folder)).join(cats, "article_idx").groupBy("topic").agg(F.count("*").alias("clicks"))


def join_full_q(spark, folder):
    imp = impressions(spark, folder)
    shown = pair_table(imp).groupBy("article_idx").agg(F.count("*").alias("n_inview"))
    got = clicks(imp).groupBy("article_idx").agg(F.count("*").alias("clicks"))
    return shown.join(got, "article_idx", "full").select("article_idx", F.coalesce("n_inview", F.lit(0)).alias("n_inview"), F.coalesce("clicks", F.lit(0)).alias("clicks"))


def join_scalar_q(spark, folder):
    """A one-row aggregate beside every row."""
    shown = pair_table(impressions(spark, folder)).groupBy("article_idx").agg(F.count("*").alias("n"))
    return shown.crossJoin(F.broadcast(shown.agg(F.max("n").alias("top")))).select("article_idx", F.round(F.col("n") / F.col("top"), 6).alias("share"))


def join_semi_q(spark, folder):
    known = articles(spark, folder).select(F.col("idx").alias("article_idx"))
    return pair_table(impressions(spark, folder)).join(known, "article_idx", "left_semi").select("imp", "position", "article_idx")


def join_anti_q(spark, folder):
    seen = history_clicks(histories(spark, folder)).select("user_idx", "article_idx").distinct()
    return drop_seen(_best(spark, folder), seen)


def join_map_bounds_q(spark, folder):
    """Users without a history never take another's: forged ids come out with nulls."""
    forged = impressions(spark, folder).select("src_row", (F.col("user_idx") + 1_000_000_000).alias("user_idx")).where("user_idx is not null")
    return forged.join(histories(spark, folder).select("user_idx", "n_hist"), "user_idx", "left").select("src_row", "n_hist")


def theta_join_q(spark, folder):
    """Clicks of the same user and article strictly earlier: an equi key with a range beside it."""
    c = table(spark, folder, "clickstream").where("user_idx is not null and article_idx is not null and ts is not null").select("user_idx", "article_idx", "ts").distinct()
    first = c.groupBy("user_idx", "article_idx").agg(F.min("ts").alias("first"))
    return c.join(first, ["user_idx", "article_idx"]).where("first < ts").select("user_idx", "article_idx", "ts", "first")


def sparse_matmul_q(spark, folder):
    """History x documents by terms: shared term counts of each user of the query set with each article."""
    i = article_index(spark, folder)
    q = history_queries(histories(spark, folder).where("user_idx % 50 = 0"), i.postings)
    return q.join(i.postings, "term").groupBy("user_idx", "doc_id").agg(F.sum(F.col("q").cast("bigint") * F.col("tf")).alias("dot"))


def sort_multi_q(spark, folder):
    rows = pair_table(impressions(spark, folder)).groupBy("article_idx", "position").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "article_idx", "position").limit(100)


def limit_slice_q(spark, folder):
    """Rows 100 to 149 by id, by range of the id, not by physical order."""
    return impressions(spark, folder, "src_row >= 100 and src_row < 150").select("src_row", "impression_id", "n_candidates")


def topk_partial_q(spark, folder):
    return top_rows(_best(spark, folder), 5, F.desc("score"), F.col("article_idx"))


def topk_merge_q(spark, folder):
    return topk_merge(_best(spark, folder).withColumn("shard", F.col("article_idx") % 4), "shard", 5).select("user_idx", "article_idx", "score", "rank")


SKEWS, SHARDS = (0.0, 0.5, 1.0), 8


def doc_sharding_q(spark, folder):
    """Top five of every user from the top fives of eight shards whose sizes fall as 1 / rank: what an unsharded ranking gives."""
    sharded = _best(spark, folder).withColumn("shard", shard_of(F.col("article_idx"), shard_bounds(SHARDS, 1.0)))
    return topk_merge(sharded, "shard", 5).select("user_idx", "article_idx", "score", "rank")


def shard_skew_q(spark, folder):
    """Candidates in the largest of eight shards against an even share, as shard sizes grow more uneven: the time of a scatter and gather is that of its largest shard."""
    best, every = _best(spark, folder), None
    for skew in SKEWS:
        sizes = best.groupBy(shard_of(F.col("article_idx"), shard_bounds(SHARDS, skew))).agg(F.count("*").alias("n"))
        one = sizes.agg(F.lit(skew).alias("skew"), F.max("n").alias("largest"), F.round(F.max("n") * SHARDS / F.sum("n"), 6).alias("slowdown"))
        every = one if every is None else every.unionByName(one)
    return every


def fan_out_q(spark, folder):
    """Share of requests slower than a budget when each asks n servers and waits for all, plainly and with a second copy of each request; the share of one server is that of read times over the budget."""
    rows = impressions(spark, folder, "read_time is not null and not isnan(read_time)")
    budgets = F.explode(F.array(*(F.lit(float(x)) for x in (30, 60, 120)))).alias("budget")
    p = rows.select("read_time", budgets).groupBy("budget").agg(F.avg((F.col("read_time").cast("double") > F.col("budget")).cast("double")).alias("p"))
    n = F.explode(F.array(*map(F.lit, (1, 4, 16, 64)))).alias("servers")
    slow = lambda x: F.round(1 - F.pow(1 - x, F.col("servers")), 6)
    return p.select("budget", "p", n).select("budget", "servers", slow(F.col("p")).alias("slow"), slow(F.col("p") * F.col("p")).alias("slow_hedged"))


def slot_chunks_q(spark, folder):
    return slot_chunks(impressions(spark, folder).select("src_row", F.greatest(F.coalesce(F.size("candidates"), F.lit(0)), F.lit(0)).alias("slots")), "src_row", "slots", 1000)


def union_all_q(spark, folder):
    a = clicks(impressions(spark, folder)).select("user_idx", "article_idx", "ts")
    b = table(spark, folder, "clickstream").select("user_idx", "article_idx", "ts", "click_id")
    return a.unionByName(b, allowMissingColumns=True).groupBy(F.col("click_id").isNull().alias("from_log")).agg(F.count("*").alias("n"), F.count_distinct("article_idx").alias("articles"))


def distinct_on_q(spark, folder):
    """Each user's first click on an article, the earliest arrival deciding equal times."""
    rows = table(spark, folder, "clickstream").where("user_idx is not null and article_idx is not null")
    first = F.row_number().over(W.partitionBy("user_idx", "article_idx").orderBy(F.asc_nulls_last("ts"), "click_id"))
    return rows.withColumn("n", first).where("n = 1").select("user_idx", "article_idx", "click_id")


def set_operations_q(spark, folder):
    """How many (user, article) pairs the stream and the history have in common, and apart."""
    a = table(spark, folder, "clickstream").select("user_idx", "article_idx").where("user_idx is not null and article_idx is not null")
    b = history_clicks(histories(spark, folder)).select("user_idx", "article_idx")
    every = a.intersect(b).withColumn("what", F.lit("both")).unionByName(a.subtract(b).withColumn("what", F.lit("stream"))).unionByName(b.subtract(a).withColumn("what", F.lit("history")))
    return every.groupBy("what").agg(F.count("*").alias("pairs"))


def article_timing_q(spark, folder):
    """Freshness of every shown row: hours since publication, whole seconds; null where no date is known."""
    born = articles(spark, folder).select(F.col("idx").alias("article_idx"), F.coalesce("published_time", "first_seen_time").alias("born"))
    return pair_table(impressions(spark, folder)).join(born, "article_idx", "left").select("imp", "position", F.round(hours(F.col("born"), F.col("time")), 6).alias("age_hours"))


def stage1_q(spark, folder):
    """The hybrid first stage: fused retrievers less what was read, 50 a user."""
    seen = history_clicks(histories(spark, folder)).select("user_idx", "article_idx").distinct()
    lists = table(spark, folder, "topk_scores").where("retriever in ('bm25', 'dense')")
    got = drop_seen(rrf(lists, "retriever", None), seen)
    return top_rows(got, 50, F.desc("score"), F.col("article_idx")).withColumn("score", F.round("score", 9))


def queueing_q(spark, folder):
    """Load and mean waits of single servers fed by each device's read times, by the textbook formulas for M/M/1 and M/D/1."""
    rows = impressions(spark, folder, "read_time is not null and not isnan(read_time) and time is not null and device_type is not null")
    span = F.timestamp_diff("SECOND", F.min("time"), F.max("time"))
    by = rows.groupBy("device_type").agg(F.avg(F.col("read_time").cast("double")).alias("service"), (F.count("*") / span).alias("rate"))
    rho = F.col("rate") * F.col("service")
    wait = F.when(rho < 1, F.col("service") * rho / (1 - rho))
    return by.select("device_type", F.round(rho, 6).alias("load"), F.round(wait, 5).alias("mm1_wait"), F.round(wait / 2, 5).alias("md1_wait"))


QUERIES = {
    "join_left_ordered": join_left_ordered_q, "join_left": join_left_q, "join_inner": join_inner_q, "join_full_coalesce": join_full_q, "join_cross_scalar": join_scalar_q, "join_semi": join_semi_q, "join_anti": join_anti_q,
    "join_map_bounds": join_map_bounds_q, "theta_join": theta_join_q, "sparse_matmul": sparse_matmul_q, "sort_multi": sort_multi_q, "limit_slice": limit_slice_q, "topk_partial": topk_partial_q, "topk_merge": topk_merge_q, "doc_sharding": doc_sharding_q, "shard_skew": shard_skew_q, "fan_out": fan_out_q,
    "slot_bounded_chunks": slot_chunks_q, "union_all": union_all_q, "distinct_on": distinct_on_q, "intersect_except": set_operations_q, "article_timing": article_timing_q, "stage1": stage1_q, "service_demand": queueing_q,
}

_BESTS = "best AS (SELECT user_idx, article_idx, max(score + 0.0) AS score FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2), rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS INT) AS rank FROM best)"
_SETS = f"WITH {HISTORY}, a AS (SELECT DISTINCT user_idx, article_idx FROM clickstream WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL), b AS (SELECT DISTINCT user_idx, article_idx FROM hist_clicks WHERE user_idx IS NOT NULL)"

ORACLES = {
    "join_left_ordered": f"WITH {PAIRS}, {ARTICLES} SELECT imp, CAST(position AS INT) AS position, topic FROM pairs LEFT JOIN art ON idx = article_idx",
    "join_left": f"WITH {IMP}, h AS (SELECT user_idx, max(n_hist) AS n_hist FROM user_history GROUP BY 1) SELECT src_row, imp.user_idx, n_hist FROM imp LEFT JOIN h ON h.user_idx = imp.user_idx",
    "join_inner": f"WITH {PAIRS}, c AS (SELECT DISTINCT user_idx, article_idx, time FROM pairs WHERE label AND user_idx IS NOT NULL AND time IS NOT NULL), e AS (SELECT user_idx, unnest(clicked) AS article_idx, time FROM imp), u AS (SELECT DISTINCT * FROM e WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND time IS NOT NULL), {ARTICLES} SELECT topic, count(*) AS clicks FROM u JOIN art ON idx = article_idx GROUP BY 1",
    "join_full_coalesce": f"WITH {PAIRS}, e AS (SELECT user_idx, unnest(clicked) AS article_idx, time FROM imp), u AS (SELECT DISTINCT * FROM e WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND time IS NOT NULL), s AS (SELECT article_idx, 1 AS v, 0 AS c FROM pairs UNION ALL SELECT article_idx, 0, 1 FROM u) SELECT article_idx, CAST(sum(v) AS BIGINT) AS n_inview, CAST(sum(c) AS BIGINT) AS clicks FROM s GROUP BY 1",
    "join_cross_scalar": f"WITH {PAIRS}, n AS (SELECT article_idx, count(*) AS n FROM pairs GROUP BY 1) SELECT article_idx, round(n / max(n) OVER (), 6) AS share FROM n",
    "join_semi": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, article_idx FROM pairs WHERE article_idx IN (SELECT idx FROM articles WHERE idx IS NOT NULL)",
    "join_anti": f"WITH {_BESTS}, {HISTORY} SELECT user_idx, article_idx, score FROM best WHERE NOT EXISTS (SELECT 1 FROM hist_clicks h WHERE h.user_idx = best.user_idx AND h.article_idx = best.article_idx)",
    "join_map_bounds": f"WITH {IMP} SELECT src_row, CAST(NULL AS BIGINT) AS n_hist FROM imp WHERE user_idx IS NOT NULL",
    "theta_join": "WITH c AS (SELECT DISTINCT user_idx, article_idx, ts FROM clickstream WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND ts IS NOT NULL) SELECT * FROM (SELECT *, min(ts) OVER (PARTITION BY user_idx, article_idx) AS first FROM c) WHERE first < ts",
    "sparse_matmul": _POSTINGS + f", {HISTORY}, q AS (SELECT user_idx, term, sum(tf) AS q FROM hist_clicks h JOIN post ON post.doc_id = h.article_idx WHERE user_idx % 50 = 0 GROUP BY 1, 2) SELECT user_idx, doc_id, CAST(sum(q * tf) AS BIGINT) AS dot FROM q JOIN post ON post.term = q.term GROUP BY 1, 2",
    "sort_multi": f"WITH {PAIRS} SELECT article_idx, CAST(position AS INT) AS position, count(*) AS n FROM pairs GROUP BY ALL ORDER BY n DESC, article_idx, position LIMIT 100",
    "limit_slice": f"WITH {IMP} SELECT src_row, impression_id, n_candidates FROM imp ORDER BY src_row LIMIT 50 OFFSET 100",
    "topk_partial": f"WITH {_BESTS} SELECT user_idx, article_idx, score, rank FROM rk WHERE rank <= 5",
    "topk_merge": f"WITH {_BESTS} SELECT user_idx, article_idx, score, rank FROM rk WHERE rank <= 5",
    "doc_sharding": f"WITH {_BESTS} SELECT user_idx, article_idx, score, rank FROM rk WHERE rank <= 5",
    "shard_skew": f"WITH {_BESTS}, u AS (SELECT {UNIFORM_SQL.format(a='article_idx', b='0', seed=41)} AS u FROM best), "
    + ", ".join(f"s{i} AS (SELECT count(*) AS n FROM u GROUP BY {' + '.join(f'CAST(u >= {b} AS INT)' for b in shard_bounds(SHARDS, skew)[:-1])})" for i, skew in enumerate(SKEWS))
    + " " + " UNION ALL ".join(f"SELECT CAST({skew} AS DOUBLE) AS skew, max(n) AS largest, round(max(n) * {SHARDS} / sum(n), 6) AS slowdown FROM s{i}" for i, skew in enumerate(SKEWS)),
    "fan_out": f"""WITH {IMP}, p AS (SELECT budget, avg(CAST(read_time::DOUBLE > budget AS INT)) AS p FROM imp, (VALUES (30::DOUBLE), (60), (120)) v(budget) WHERE read_time IS NOT NULL AND NOT isnan(read_time) GROUP BY 1)
        SELECT budget, CAST(s AS INT) AS servers, round(1 - pow(1 - p, s), 6) AS slow, round(1 - pow(1 - p * p, s), 6) AS slow_hedged FROM p, (VALUES (1), (4), (16), (64)) n(s)""",
    "slot_bounded_chunks": f"WITH {IMP}, s AS (SELECT src_row, CAST(coalesce(len(candidates), 0) AS INT) AS slots FROM imp) SELECT src_row, slots, CAST(floor(coalesce(sum(slots) OVER (ORDER BY src_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000) AS BIGINT) AS chunk FROM s",
    "union_all": f"WITH {IMP}, e AS (SELECT user_idx, unnest(clicked) AS article_idx, time FROM imp), u AS (SELECT DISTINCT * FROM e WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND time IS NOT NULL) SELECT true AS from_log, count(*) AS n, count(DISTINCT article_idx) AS articles FROM u UNION ALL SELECT false, count(*), count(DISTINCT article_idx) FROM clickstream",
    "distinct_on": "SELECT DISTINCT ON (user_idx, article_idx) user_idx, article_idx, click_id FROM clickstream WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL ORDER BY user_idx, article_idx, ts NULLS LAST, click_id",
    "intersect_except": _SETS + " SELECT 'both' AS what, count(*) AS pairs FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'stream', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'history', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "article_timing": f"WITH {PAIRS}, {ARTICLES} SELECT imp, CAST(position AS INT) AS position, round(date_sub('second', coalesce(published_time, first_seen_time), time) / 3600.0, 6) AS age_hours FROM pairs LEFT JOIN art ON idx = article_idx",
    "stage1": f"""WITH {HISTORY}, b AS (SELECT user_idx, retriever, article_idx, max(score + 0.0) AS s FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND retriever IN ('bm25', 'dense') AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_idx, retriever ORDER BY s DESC, article_idx) AS r FROM b), f AS (SELECT user_idx, article_idx, round(sum(1.0 / (60 + r)), 12) AS score FROM r GROUP BY 1, 2),
        k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM hist_clicks h WHERE h.user_idx = f.user_idx AND h.article_idx = f.article_idx))
        SELECT user_idx, article_idx, round(score, 9) AS score, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS INT) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) <= 50""",
    "service_demand": f"""WITH {IMP}, g AS (SELECT device_type, avg(CAST(read_time AS DOUBLE)) AS s, count(*) / date_sub('second', min(time), max(time)) AS l FROM imp WHERE read_time IS NOT NULL AND NOT isnan(read_time) AND time IS NOT NULL AND device_type IS NOT NULL GROUP BY 1)
        SELECT device_type, round(l * s, 6) AS load, round(CASE WHEN l * s < 1 THEN s * l * s / (1 - l * s) END, 5) AS mm1_wait, round(CASE WHEN l * s < 1 THEN s * l * s / (1 - l * s) / 2 END, 5) AS md1_wait FROM g""",
}
