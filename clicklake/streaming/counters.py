"""Streams of the click log: rolling counters, windows with watermarks, sessions and de-duplication, with bounded state.

What comes later than the watermark allows is dropped by the engine, and the last windows stay open; the oracles say which.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clicklake.plans.cut import shared_dir
from clicklake.sources.tables import table


def stream_of(spark: SparkSession, folder: str, name: str, files_a_batch: int = 8) -> DataFrame:
    """A table's files as a stream, a few a micro-batch, under the schema of the table."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream's path must be a folder


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return its result, written with its checkpoint in the shared folder.

    Append goes to Parquet, exactly once; complete mode keeps the last batch's table.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def replayed(rows: DataFrame, arrival: str, build: Callable[[DataFrame], DataFrame], parts: int = 5) -> DataFrame:
    """What a stream gives when `rows` come in `parts` deliveries, cut at equal steps of the integer `arrival`.

    Each delivery is written to the landing folder, and the same streaming query, in append mode and with one checkpoint, is
    started on what is new and runs until that is used up: state, watermark and output go on from run to run.
    """
    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    lo, hi = rows.agg(F.min(arrival), F.max(arrival)).first()
    part = F.floor((F.col(arrival) - F.lit(lo)) * parts / F.lit((hi or 0) - (lo or 0) + 1)) if lo is not None else F.lit(0)
    for i in range(parts):
        rows.where(part == i).write.mode("append").parquet(f"{base}/landing")
        out = build(spark.readStream.schema(rows.schema).parquet(f"{base}/landing"))
        out.writeStream.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).outputMode("append").format("parquet").option("path", f"{base}/out").start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def windowed(events: DataFrame, time: str, key: str, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, key, n) over tumbling or sliding windows; rows later than the watermark are dropped by the engine."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    over = F.window("_at", length, slide) if slide else F.window("_at", length)
    return rows.groupBy(over, key).agg(F.count("*").alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("window.end").cast("timestamp_ntz").alias("end"), key, "n")


def session_windows(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of sessions: the built-in session window, which ends one gap after its last event."""
    rows = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.session_window("_at", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("end"), "n")


def _count(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counters of one article: a row for each instant of the batch, including what came in earlier batches."""
    shown, clicked, last = state.get if state.exists else (0, 0, pd.Timestamp(0))
    rows = pd.concat(list(parts))
    late = int((rows["at"] < last).sum())
    once = rows[rows["at"] >= last].groupby("at", as_index=False).agg(n=("label", "size"), c=("label", "sum")).sort_values("at")
    if not len(once):  # only late rows: their number still comes out
        once = pd.DataFrame({"at": [last], "n": [0], "c": [0]})
    once["roll_inview"], once["roll_clicks"] = shown + once["n"].cumsum(), clicked + once["c"].cumsum()
    last = once["at"].iloc[-1]
    shown, clicked = int(once["roll_inview"].iloc[-1]), int(once["roll_clicks"].iloc[-1])
    yield pd.DataFrame({"article_idx": key[0], "at": once["at"], "roll_inview": once["roll_inview"].astype("int64"), "roll_clicks": once["roll_clicks"].astype("int64"), "late": [late] + [0] * (len(once) - 1)})
    state.update((shown, clicked, last))


def rolling_counters(shown: DataFrame) -> DataFrame:
    """Running exposures and clicks of each article by instant: a custom operator with three numbers of state an article.

    Rows before the last instant already emitted are late: they are left out of the counters, and their number is in `late` of
    the batch's first row, which comes out even if all rows of a batch are late.
    """
    rows = shown.where("article_idx is not null and time is not null").select("article_idx", F.col("time").cast("timestamp").alias("at"), F.coalesce("label", F.lit(False)).cast("int").alias("label"))
    return rows.groupBy("article_idx").applyInPandasWithState(_count, "article_idx bigint, at timestamp, roll_inview bigint, roll_clicks bigint, late bigint", "shown bigint, clicked bigint, last timestamp", "append", GroupStateTimeout.NoTimeout)


def deduplicated(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first of rows with one key among those that the watermark lets through; keys are forgotten once it has passed them."""
    at = rows.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    return at.dropDuplicatesWithinWatermark([key]).drop("_at")


# queries: tables in five deliveries, in order of arrival

PARTS, LATE_HOURS = 5, 6


def _clicks(spark, folder):
    return table(spark, folder, "clickstream").where("user_idx is not null and ts is not null").select("click_id", "user_idx", "ts", F.pmod("article_idx", F.lit(7)).alias("kind"))


def stream_tumbling_q(spark, folder):
    return replayed(_clicks(spark, folder), "click_id", lambda s: windowed(s, "ts", "kind", "1 day", late=f"{LATE_HOURS} hours"), PARTS)


def stream_sliding_q(spark, folder):
    return replayed(_clicks(spark, folder), "click_id", lambda s: windowed(s, "ts", "kind", "2 days", "1 day", late=f"{LATE_HOURS} hours"), PARTS)


def stream_sessions_q(spark, folder):
    """Sessions of the users of the event table, whose rows come in no order of time: a watermark of 100 days keeps all, then a last event closes them."""
    rows = table(spark, folder, "events").where("user_id is not null and ts is not null").select("event_id", "user_id", "ts")
    end = rows.agg((F.max("event_id") + 1).alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.timestamp_add("DAY", F.lit(300), F.max("ts")).alias("ts"))
    return replayed(rows.unionByName(end), "event_id", lambda s: session_windows(s, "ts", "user_id", late="100 days"), PARTS).where("user_id >= 0")


def stream_dedup_q(spark, folder):
    """Impressions counted once in a stream, by their row id, per device."""
    rows = table(spark, folder, "impressions").where("time is not null and src_row is not null").select("src_row", "device_type", "time")
    got = replayed(rows, "src_row", lambda s: deduplicated(s, "src_row", "time", f"{24 * LATE_HOURS} hours"), PARTS)
    return got.groupBy("device_type").agg(F.count("*").alias("n"))


def stream_rolling_counters_q(spark, folder):
    rows = table(spark, folder, "behaviour").where("pair_id is not null").select("pair_id", "article_idx", "time", "label")
    got = replayed(rows, "pair_id", rolling_counters, PARTS)
    return got.groupBy("article_idx").agg(F.max("roll_inview").alias("inview"), F.max("roll_clicks").alias("clicks"), F.sum("late").alias("late"))


QUERIES: dict[str, Callable] = {
    "stream_tumbling": stream_tumbling_q, "stream_sliding": stream_sliding_q, "stream_sessions": stream_sessions_q, "stream_dedup": stream_dedup_q, "stream_rolling_counters": stream_rolling_counters_q,
}


def _delivered(table_name: str, arrival: str, time: str, where: str) -> str:
    """Rows with their delivery, and the watermark that a delivery finds: the latest time of those before it, less the delay."""
    return f"""WITH r AS (SELECT * FROM {table_name} WHERE {where}), p AS (SELECT *, CAST(floor(({arrival} - (SELECT min({arrival}) FROM r)) * {PARTS} / (SELECT max({arrival}) - min({arrival}) + 1 FROM r)) AS INT) AS part FROM r),
m AS (SELECT part, max({time}) AS top FROM p GROUP BY 1), w AS (SELECT i AS part, (SELECT max(top) FROM m WHERE m.part < i) AS seen FROM range({PARTS}) t(i)), d AS (SELECT p.*, w.seen FROM p JOIN w ON w.part = p.part)"""


def _windows(starts: str, days: int) -> str:
    delay = f"INTERVAL {LATE_HOURS} HOUR"
    return (
        _delivered("clickstream", "click_id", "ts", "user_idx IS NOT NULL AND ts IS NOT NULL")
        + f""", o AS (SELECT article_idx % 7 AS kind, seen, unnest({starts})::TIMESTAMP AS start FROM d), k AS (SELECT *, start + INTERVAL {days} DAY AS fin FROM o)
        SELECT start, fin AS "end", kind, count(*) AS n FROM k WHERE (seen IS NULL OR fin > seen - {delay}) AND fin <= (SELECT max(ts) FROM r) - {delay} GROUP BY 1, 2, 3"""
    )


ORACLES = {
    "stream_tumbling": _windows("[date_trunc('day', ts)]", 1),
    "stream_sliding": _windows("[date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]", 2),
    "stream_sessions": """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM f)
        SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, no""",
    "stream_dedup": _delivered("impressions", "src_row", "time", "time IS NOT NULL AND src_row IS NOT NULL") + f" SELECT device_type, count(DISTINCT src_row) AS n FROM d WHERE seen IS NULL OR time > date_trunc('milliseconds', seen) - INTERVAL {24 * LATE_HOURS} HOUR GROUP BY 1",
    "stream_rolling_counters": _delivered("behaviour", "pair_id", "time", "pair_id IS NOT NULL") + """, x AS (SELECT *, (SELECT max(e.time) FROM (SELECT article_idx, part, max(time) AS time FROM d GROUP BY 1, 2) e WHERE e.article_idx = d.article_idx AND e.part < d.part) AS last FROM d WHERE article_idx IS NOT NULL AND time IS NOT NULL)
        SELECT article_idx, count(*) FILTER (last IS NULL OR time >= last) AS inview, count(*) FILTER (label AND (last IS NULL OR time >= last)) AS clicks, CAST(count(*) FILTER (time < last) AS BIGINT) AS late FROM x GROUP BY 1""",
}
