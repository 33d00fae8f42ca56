"""The click log with deliveries counted once, as tables for the operators and as SQL for their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.sources.tables import table

#: The log is cut in three by time: train before the first instant, validation before the second, then test.
VAL_FROM, TEST_FROM = "2024-10-01 00:00:00", "2024-10-08 00:00:00"
CUTOFF = TEST_FROM


def at(text: str):
    """A zoneless timestamp literal."""
    return F.expr(f"timestamp_ntz'{text}'")


def impressions(spark: SparkSession, folder: str, condition: Column | str | None = None) -> DataFrame:
    """One row per `src_row`: rows delivered twice are alike, so any of them will do.

    A condition is applied before they are counted once, where it reaches the scan; after, it could not pass the aggregate.
    """
    rows = table(spark, folder, "impressions")
    return (rows if condition is None else rows.where(condition)).dropDuplicates(["src_row"])


def pair_table(imp: DataFrame, *keep: str) -> DataFrame:
    """One row per impression and shown candidate: imp, user_idx, time, article_idx, position, position_frac, n_candidates, label.

    Null or empty lists give no row; a null `clicked` is no click. No shuffle: the list is opened where it lies.
    """
    n = F.size("candidates")
    rows = imp.select(F.col("src_row").alias("imp"), "user_idx", "time", *keep, n.alias("n_candidates"), F.coalesce("clicked", F.array().cast("array<bigint>")).alias("_clicked"), F.posexplode("candidates").alias("position", "article_idx"))
    frac = F.col("position") / F.greatest(F.col("n_candidates") - 1, F.lit(1))
    return rows.select("imp", "user_idx", "time", *keep, "article_idx", "position", frac.alias("position_frac"), "n_candidates", F.coalesce(F.array_contains("_clicked", F.col("article_idx")), F.lit(False)).alias("label"))


def clicks(imp: DataFrame) -> DataFrame:
    """(user_idx, article_idx, ts), distinct: the clicks of the labelled impressions."""
    return imp.select("user_idx", F.explode("clicked").alias("article_idx"), F.col("time").alias("ts")).where("user_idx is not null and article_idx is not null and ts is not null").distinct()


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """One row per `idx`, the one with most pageviews, and `topic`: the category in lower case without outer blanks."""
    rows = table(spark, folder, "articles").withColumn("topic", F.lower(F.trim("category")))
    first = F.row_number().over(W.partitionBy("idx").orderBy(F.desc_nulls_last("total_pageviews")))
    return rows.where("idx is not null").withColumn("_first", first).where("_first = 1").drop("_first")


def histories(spark: SparkSession, folder: str) -> DataFrame:
    """One row per user with a history; users delivered twice have the same one."""
    return table(spark, folder, "user_history").dropDuplicates(["user_idx"])


def history_clicks(history: DataFrame) -> DataFrame:
    """(user_idx, i, article_idx, ts) of every history click, ts null where the list of times is null or shorter."""
    rows = history.select("user_idx", "ts", F.posexplode("article_idx").alias("i", "article_idx"))
    return rows.select("user_idx", "i", "article_idx", F.get("ts", F.col("i")).alias("ts")).where("article_idx is not null")


#: The same tables for the oracles.
IMP = "imp AS (SELECT DISTINCT ON (src_row) * FROM impressions)"
PAIRS = IMP + """,
opened AS (SELECT src_row AS imp, user_idx, time, len(candidates) AS n_candidates, unnest(candidates) AS article_idx, unnest(range(len(candidates))) AS position, coalesce(clicked, []) AS clicked FROM imp),
pairs AS (SELECT imp, user_idx, time, article_idx, position, n_candidates, coalesce(list_contains(clicked, article_idx), false) AS label FROM opened)"""
CLICKS = IMP + """,
raw_clicks AS (SELECT user_idx, unnest(clicked) AS article_idx, time AS ts FROM imp),
clicks AS (SELECT DISTINCT * FROM raw_clicks WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND ts IS NOT NULL)"""
ARTICLES = "art AS (SELECT *, lower(trim(category)) AS topic FROM articles WHERE idx IS NOT NULL QUALIFY row_number() OVER (PARTITION BY idx ORDER BY total_pageviews DESC NULLS LAST) = 1)"
HISTORY = """hist AS (SELECT DISTINCT ON (user_idx) * FROM user_history),
hist_open AS (SELECT user_idx, unnest(range(len(article_idx))) AS i, unnest(article_idx) AS article_idx, ts AS times FROM hist),
hist_clicks AS (SELECT user_idx, i, article_idx, times[i + 1] AS ts FROM hist_open WHERE article_idx IS NOT NULL)"""
