"""Sessions separated by pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.functions.times import from_micros, micros
from clicklake.sources.tables import table


def sessions(df: DataFrame, user: str, time: str, row_id: str, gap_seconds: int = 1800, bucket_seconds: int = 3600) -> DataFrame:
    """(user, session_no, start, end, duration_s, n_events, first_row, last_row), one row per session of each user.

    Events run by time, then id; a pause longer than the gap starts a session. An event delivered again (same user, time
    and id) counts once; null users and times are left out; a null id is an id like any other, before all others.

    Lag flags the pauses and a running sum numbers the sessions, first within (user, time bucket), so that no user's
    events meet in one task, then over the parts found there. Parts of a user lie more than a gap or a bucket's edge
    apart, so their number depends on the length of the log, not on how many events it holds.
    """
    gap, width = gap_seconds * 1_000_000, bucket_seconds * 1_000_000
    rows = df.select(F.col(user).alias("user"), micros(F.col(time)).alias("t"), F.col(row_id).alias("id")).where("user is not null and t is not null")
    rows = rows.withColumn("bucket", F.floor(F.col("t") / width))
    w = W.partitionBy("user", "bucket").orderBy("t", F.col("id").asc_nulls_first())
    rows = rows.withColumns({"before": F.lag("t").over(w), "same": (F.lag("t").over(w) == F.col("t")) & F.lag("id").over(w).eqNullSafe(F.col("id"))})
    rows = rows.withColumn("part", F.sum(F.when(F.col("t") - F.col("before") > gap, 1).otherwise(0)).over(w))
    at = F.struct("t", "id")
    parts = rows.groupBy("user", "bucket", "part").agg(F.min(at).alias("a"), F.max(at).alias("b"), F.sum(F.when(F.col("same"), 0).otherwise(1)).alias("n"))
    w = W.partitionBy("user").orderBy("a.t")
    parts = parts.withColumn("no", F.sum(F.when(F.col("a.t") - F.lag("b.t").over(w) > gap, 1).otherwise(0)).over(w))
    whole = parts.groupBy("user", "no").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    return whole.select("user", F.col("no").cast("long").alias("session_no"), from_micros(F.col("a.t")).alias("start"), from_micros(F.col("b.t")).alias("end"), ((F.col("b.t") - F.col("a.t")) / 1e6).alias("duration_s"), F.col("n").cast("long").alias("n_events"), F.col("a.id").alias("first_row"), F.col("b.id").alias("last_row"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """First and last impression of every session."""
    found = sessions(table(spark, folder, "impressions"), "user_idx", "time", "src_row")
    return found.select(F.col("user").alias("user_idx"), F.col("first_row").alias("first_src_row"), F.col("last_row").alias("last_src_row"))


def p6_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Start, end, duration and number of impressions of every session."""
    found = sessions(table(spark, folder, "impressions"), "user_idx", "time", "src_row")
    return found.select(F.col("user").alias("user_idx"), "session_no", "start", "end", F.round("duration_s", 6).alias("duration_s"), "n_events")


QUERIES = {"p6_found": p6_found, "p6_sessions": p6_sessions}

_SESSIONS = """
WITH once AS (SELECT DISTINCT src_row, user_idx, time FROM impressions WHERE user_idx IS NOT NULL AND time IS NOT NULL),
f AS (SELECT *, CASE WHEN time - lag(time) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM once WINDOW w AS (PARTITION BY user_idx ORDER BY time, src_row)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_idx ORDER BY time, src_row ROWS UNBOUNDED PRECEDING) AS no FROM f)
"""

ORACLES = {
    "p6_found": _SESSIONS + "SELECT user_idx, arg_min(src_row, (time, src_row)) AS first_src_row, arg_max(src_row, (time, src_row)) AS last_src_row FROM s GROUP BY user_idx, no",
    "p6_sessions": _SESSIONS + """SELECT user_idx, CAST(no AS BIGINT) AS session_no, min(time) AS "start", max(time) AS "end",
        round(date_diff('microsecond', min(time), max(time)) / 1e6, 6) AS duration_s, count(*) AS n_events FROM s GROUP BY user_idx, no""",
}
