"""Features that read only what lies strictly before a row: sessions, dwell, rolling counters, and the as-of join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.functions.times import micros
from clicklake.operators.features import hours
from clicklake.sources.logs import CLICKS, IMP, PAIRS, articles, clicks, impressions, pair_table
from clicklake.sources.tables import table


def running(rows: DataFrame, key: str, time: str, sums: Sequence[str], strict: bool, bucket_seconds: int = 86_400) -> DataFrame:
    """(key, time, *sums): the sums of each column over all instants of the key up to this one, or before it if `strict`.

    `rows` has one row per (key, instant). Sums run within (key, time bucket), and what earlier buckets add up to is one row
    per (key, bucket), so a hot key is split over its buckets. An empty sum is 0.
    """
    bucketed = rows.select(key, time, *sums, F.floor(micros(F.col(time)) / (bucket_seconds * 1_000_000)).alias("_bucket"))
    inside = W.partitionBy(key, "_bucket").orderBy(time).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    own = bucketed.select(key, time, "_bucket", *(F.sum(c).over(inside).alias(c) for c in sums))
    # a bucket's total is its last running sum, so sums of fractions are added in order of time and rows may lie anywhere
    totals = own.groupBy(key, "_bucket").agg(F.max_by(F.struct(*sums), time).alias("t")).select(key, "_bucket", *(F.col("t")[c].alias(c) for c in sums))
    before = totals.select(key, "_bucket", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    if strict:
        last = W.partitionBy(key, "_bucket").orderBy(time)
        own = own.select(key, time, "_bucket", *(F.coalesce(F.lag(c).over(last), F.lit(0)).alias(c) for c in sums))
    return own.join(before, [key, "_bucket"]).select(key, time, *((F.col(c) + F.col(f"_{c}")).alias(c) for c in sums))


def session_features(imp: DataFrame) -> DataFrame:
    """(imp, session_rank, session_seconds, secs_since_prev) by (user, session_id), time and `src_row`: the past only.

    Rows without user, session or time are left out; seconds are whole.
    """
    rows = imp.where("user_idx is not null and session_id is not null and time is not null")
    w = W.partitionBy("user_idx", "session_id").orderBy("time", "src_row")
    since = lambda t: F.timestamp_diff("SECOND", t, F.col("time"))
    return rows.select(F.col("src_row").alias("imp"), (F.row_number().over(w) - 1).alias("session_rank"), since(F.first("time").over(w)).alias("session_seconds"), since(F.lag("time").over(w)).alias("secs_since_prev"))


def dwell_features(imp: DataFrame) -> DataFrame:
    """(imp, prior_read_time, prior_scroll, prior_impressions): a user's means over impressions of strictly earlier instants.

    A null read time counts as 0 but its row counts; scrolling is averaged where known, null where it never was. Instants
    are combined before the window, so ties see the same past and the result does not depend on row order.
    """
    clean = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = imp.where("user_idx is not null and time is not null").select(F.col("src_row").alias("imp"), "user_idx", "time", clean("read_time").alias("read_time"), clean("scroll_percentage").alias("scroll"))
    once = rows.groupBy("user_idx", "time").agg(F.sum(F.coalesce("read_time", F.lit(0.0))).alias("rt"), F.count("*").alias("n"), F.sum("scroll").alias("sc"), F.count("scroll").alias("scn"))
    before = running(once.withColumn("sc", F.coalesce("sc", F.lit(0.0))), "user_idx", "time", ("rt", "n", "sc", "scn"), True)
    return rows.select("imp", "user_idx", "time").join(before, ["user_idx", "time"]).select("imp", F.try_divide("rt", "n").alias("prior_read_time"), F.try_divide("sc", "scn").alias("prior_scroll"), F.col("n").alias("prior_impressions"))


def article_dwell(imp: DataFrame) -> DataFrame:
    """(article_idx, time, art_read_time, art_dwell_n): the mean read time of the visits an article had got by each instant."""
    read = F.coalesce(F.nanvl(F.col("read_time").cast("double"), F.lit(None)), F.lit(0.0))
    rows = imp.select(F.explode("clicked").alias("article_idx"), "time", read.alias("rt")).where("article_idx is not null and time is not null")
    once = rows.groupBy("article_idx", "time").agg(F.sum("rt").alias("rt"), F.count("*").alias("n"))
    return running(once, "article_idx", "time", ("rt", "n"), False).select("article_idx", "time", (F.col("rt") / F.col("n")).alias("art_read_time"), F.col("n").alias("art_dwell_n"))


def rolling_article_stats(pairs: DataFrame, article: DataFrame, smoothing: float = 20.0) -> DataFrame:
    """(article_idx, time, roll_inview, roll_clicks, roll_ctr, roll_age_hours) at every instant an article was shown.

    Counters include the instant; a reader joins strictly before. The age is that at the counters' instant.
    """
    once = pairs.where("article_idx is not null and time is not null").groupBy("article_idx", "time").agg(F.count("*").alias("n"), F.count_if("label").alias("c"))
    rows = running(once, "article_idx", "time", ("n", "c"), False).withColumnsRenamed({"n": "roll_inview", "c": "roll_clicks"})
    born = article.select(F.col("idx").alias("article_idx"), F.coalesce("published_time", "first_seen_time").alias("born"))
    return rows.join(born, "article_idx", "left").select("article_idx", "time", "roll_inview", "roll_clicks", (F.col("roll_clicks") / (F.col("roll_inview") + smoothing)).alias("roll_ctr"), hours(F.col("born"), F.col("time")).alias("roll_age_hours"))


def asof_before(left: DataFrame, right: DataFrame, by: str, on: str, values: Sequence[str], bucket_seconds: int = 86_400) -> DataFrame:
    """Left rows with the `values` of the last right row of the same key strictly before them; null where there is none."""
    return asof_before_all(left, [(right, values)], by, on, bucket_seconds)


def asof_before_all(left: DataFrame, rights: Sequence[tuple[DataFrame, Sequence[str]]], by: str, on: str, bucket_seconds: int = 86_400) -> DataFrame:
    """`asof_before` of several right tables at once, whose values have different names.

    All sides are stacked and one window per (key, time bucket) carries the last right values forward, a left row sorting
    before right rows of its own instant. What earlier buckets leave to carry is one row per (key, bucket), so a hot key is
    split over its buckets. Each right table has one row per (key, instant). Left rows of null key or time keep nulls. The
    left columns travel through a sort: pass few, and join wide ones on later.
    """
    width = bucket_seconds * 1_000_000
    kept, names = list(left.columns), [f"v{i}" for i in range(len(rights))]
    a = left.select(F.struct(*kept).alias("row"), F.col(by).alias("k"), micros(F.col(on)).alias("t"), F.lit(0).alias("side"))
    stacked, ends = a, a.where("k is not null and t is not null").select("k", F.floor(F.col("t") / width).alias("bucket")).distinct().withColumn("asks", F.lit(True))
    for name, (right, values) in zip(names, rights):
        b = right.where(f"{by} is not null and {on} is not null").select(F.col(by).alias("k"), micros(F.col(on)).alias("t"), F.struct(*values).alias(name), F.lit(1).alias("side"))
        stacked = stacked.unionByName(b, allowMissingColumns=True)
        # the last right value of each bucket; beside the buckets left rows lie in, which carry what earlier buckets end with
        ends = ends.unionByName(b.groupBy("k", F.floor(F.col("t") / width).alias("bucket")).agg(F.max_by(name, "t").alias(name)).withColumn("asks", F.lit(False)), allowMissingColumns=True)
    earlier = W.partitionBy("k").orderBy("bucket").rangeBetween(W.unboundedPreceding, -1)
    carried = ends.select("k", "bucket", "asks", *(F.last(n, ignorenulls=True).over(earlier).alias(f"c_{n}") for n in names)).where("asks").drop("asks")
    w = W.partitionBy("k", "bucket").orderBy("t", "side").rowsBetween(W.unboundedPreceding, -1)
    stacked = stacked.withColumn("bucket", F.floor(F.col("t") / width))
    inside = stacked.select("row", "k", "bucket", "side", *(F.last(n, ignorenulls=True).over(w).alias(n) for n in names)).where("side = 0")
    met = inside.join(carried, ["k", "bucket"], "left")
    known = F.col("k").isNotNull() & F.col("bucket").isNotNull()
    values = [F.when(known, F.coalesce(n, f"c_{n}"))[c].alias(c) for n, (_, own) in zip(names, rights) for c in own]
    return met.select(*(F.col("row")[c].alias(c) for c in kept), *values)


def midrank(value: Column, *group: str) -> Column:
    """Rank of a value within its group, 1 for the least, the mean of their ranks for equal ones."""
    w = W.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(W.partitionBy(*group, value)) - 1) / 2


# queries


def session_features_q(spark, folder):
    return session_features(impressions(spark, folder))


def dwell_features_q(spark, folder):
    out = dwell_features(impressions(spark, folder))
    return out.withColumns({c: F.round(c, 5) for c in ("prior_read_time", "prior_scroll")})


def article_dwell_q(spark, folder):
    return article_dwell(impressions(spark, folder)).withColumn("art_read_time", F.round("art_read_time", 5))


def rolling_article_stats_q(spark, folder):
    out = rolling_article_stats(pair_table(impressions(spark, folder)), articles(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("roll_ctr", "roll_age_hours")})


def join_asof_strict_q(spark, folder):
    pairs = pair_table(impressions(spark, folder))
    stats = rolling_article_stats(pairs, articles(spark, folder))
    out = asof_before(pairs.select("imp", "position", "article_idx", "time"), stats, "article_idx", "time", ["roll_inview", "roll_clicks"])
    return out.select("imp", "position", "article_idx", "roll_inview", "roll_clicks")


def rank_average_q(spark, folder):
    rows = pair_table(impressions(spark, folder)).withColumn("s", F.col("article_idx") % 5)
    return rows.select("imp", "position", midrank(F.col("s"), "imp").alias("rank"))


def rank_ordinal_desc_q(spark, folder):
    rows = pair_table(impressions(spark, folder)).withColumn("s", F.col("article_idx") % 5)
    return rows.select("imp", "position", F.row_number().over(W.partitionBy("imp").orderBy(F.desc("s"), "article_idx", "position")).alias("rank"))


def topk_lists_q(spark, folder):
    rows = pair_table(impressions(spark, folder)).withColumn("s", F.col("article_idx") % 5)
    best = rows.withColumn("r", F.row_number().over(W.partitionBy("imp").orderBy(F.desc("s"), "article_idx", "position"))).where("r <= 5")
    return best.groupBy("imp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "article_idx"))), lambda x: x["article_idx"].cast("string")), ",").alias("top"))


def over_share_q(spark, folder):
    rows = clicks(impressions(spark, folder)).groupBy("user_idx", "article_idx").agg(F.count("*").alias("n"))
    w = W.partitionBy("user_idx")
    return rows.select("user_idx", "article_idx", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.count("*").over(w).alias("articles"))


def k_sweep_q(spark, folder):
    """Of each user's retrieved candidates, ranked again: how many rows and users are left at each depth."""
    best = table(spark, folder, "topk_scores").where("user_idx is not null and article_idx is not null and score is not null and not isnan(score)").groupBy("user_idx", "article_idx").agg(F.max(F.col("score") + 0.0).alias("score"))
    ranked = best.withColumn("r", F.row_number().over(W.partitionBy("user_idx").orderBy(F.desc("score"), "article_idx"))).where("r <= 50")
    depth = F.explode(F.filter(F.array(*map(F.lit, (5, 10, 20, 50))), lambda k: F.col("r") <= k)).alias("k")
    return ranked.select("user_idx", "score", depth).groupBy("k").agg(F.count("*").alias("rows"), F.count_distinct("user_idx").alias("users"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {
    "session_features": session_features_q, "dwell_features": dwell_features_q, "article_dwell": article_dwell_q, "rolling_article_stats": rolling_article_stats_q, "join_asof_strict": join_asof_strict_q,
    "rank_average": rank_average_q, "rank_ordinal_desc": rank_ordinal_desc_q, "topk_lists": topk_lists_q, "over_share": over_share_q, "k_sweep": k_sweep_q,
}

_STATS = f"""WITH {PAIRS}, o AS (SELECT article_idx, time, count(*) AS n, count(*) FILTER (label) AS c FROM pairs WHERE article_idx IS NOT NULL AND time IS NOT NULL GROUP BY 1, 2),
st AS (SELECT article_idx, time, CAST(sum(n) OVER w AS BIGINT) AS roll_inview, CAST(sum(c) OVER w AS BIGINT) AS roll_clicks FROM o WINDOW w AS (PARTITION BY article_idx ORDER BY time RANGE UNBOUNDED PRECEDING))"""

ORACLES = {
    "session_features": f"""WITH {IMP}, r AS (SELECT * FROM imp WHERE user_idx IS NOT NULL AND session_id IS NOT NULL AND time IS NOT NULL)
        SELECT src_row AS imp, CAST(row_number() OVER w - 1 AS INT) AS session_rank, date_sub('second', min(time) OVER (PARTITION BY user_idx, session_id), time) AS session_seconds, date_sub('second', lag(time) OVER w, time) AS secs_since_prev
        FROM r WINDOW w AS (PARTITION BY user_idx, session_id ORDER BY time, src_row)""",
    "dwell_features": f"""WITH {IMP}, r AS (SELECT src_row, user_idx, time, CASE WHEN isnan(read_time) THEN NULL ELSE CAST(read_time AS DOUBLE) END AS rt, CASE WHEN isnan(scroll_percentage) THEN NULL ELSE CAST(scroll_percentage AS DOUBLE) END AS sc FROM imp WHERE user_idx IS NOT NULL AND time IS NOT NULL),
        c AS (SELECT src_row, sum(coalesce(rt, 0)) OVER w AS rt, count(*) OVER w AS n, sum(sc) OVER w AS sc, count(sc) OVER w AS scn FROM r WINDOW w AS (PARTITION BY user_idx ORDER BY time RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
        SELECT src_row AS imp, round(rt / nullif(n, 0), 5) AS prior_read_time, round(sc / nullif(scn, 0), 5) AS prior_scroll, n AS prior_impressions FROM c""",
    "article_dwell": f"""WITH {IMP}, o AS (SELECT unnest(clicked) AS article_idx, time, CASE WHEN isnan(read_time) THEN 0 ELSE coalesce(CAST(read_time AS DOUBLE), 0) END AS rt FROM imp),
        g AS (SELECT DISTINCT article_idx, time, sum(rt) OVER w AS rt, count(*) OVER w AS n FROM o WHERE article_idx IS NOT NULL AND time IS NOT NULL WINDOW w AS (PARTITION BY article_idx ORDER BY time RANGE UNBOUNDED PRECEDING))
        SELECT article_idx, time, round(rt / n, 5) AS art_read_time, n AS art_dwell_n FROM g""",
    "rolling_article_stats": _STATS + f""", born AS (SELECT idx, coalesce(published_time, first_seen_time) AS b FROM articles QUALIFY row_number() OVER (PARTITION BY idx ORDER BY total_pageviews DESC NULLS LAST) = 1)
        SELECT article_idx, time, roll_inview, roll_clicks, round(roll_clicks / (roll_inview + 20.0), 6) AS roll_ctr, round(date_sub('second', b, time) / 3600.0, 6) AS roll_age_hours FROM st LEFT JOIN born ON idx = article_idx""",
    "join_asof_strict": _STATS + " SELECT imp, CAST(position AS INT) AS position, p.article_idx, roll_inview, roll_clicks FROM pairs p ASOF LEFT JOIN st ON p.article_idx = st.article_idx AND p.time > st.time",
    "rank_average": f"WITH {PAIRS} SELECT p.imp, CAST(p.position AS INT) AS position, (SELECT 1 + count(*) FILTER (q.article_idx % 5 < p.article_idx % 5) + (count(*) FILTER (q.article_idx % 5 = p.article_idx % 5) - 1) / 2 FROM pairs q WHERE q.imp = p.imp) AS rank FROM pairs p",
    "rank_ordinal_desc": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, CAST(row_number() OVER (PARTITION BY imp ORDER BY article_idx % 5 DESC, article_idx, position) AS INT) AS rank FROM pairs",
    "topk_lists": f"WITH {PAIRS} SELECT imp, array_to_string(list(article_idx ORDER BY article_idx % 5 DESC, article_idx, position)[1:5], ',') AS top FROM pairs GROUP BY 1",
    "over_share": f"WITH {CLICKS}, g AS (SELECT user_idx, article_idx, count(*) AS n FROM clicks GROUP BY 1, 2) SELECT user_idx, article_idx, round(n / sum(n) OVER (PARTITION BY user_idx), 6) AS share, count(*) OVER (PARTITION BY user_idx) AS articles FROM g",
    "k_sweep": """WITH b AS (SELECT user_idx, article_idx, max(score + 0.0) AS score FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS r FROM b) SELECT k, count(*) AS rows, count(DISTINCT user_idx) AS users, round(avg(score), 6) AS mean_score FROM r JOIN (VALUES (5), (10), (20), (50)) v(k) ON r.r <= k GROUP BY 1""",
}
