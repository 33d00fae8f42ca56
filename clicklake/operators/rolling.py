"""Rolling totals over trailing days by binary doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.sources.tables import table


def daily_counts(df: DataFrame, entity: str, time: str, label: str, row_id: str) -> DataFrame:
    """(entity, day, inview, clicks) of an exposure log, each `row_id` counted once.

    Rows with a null entity or time are left out; a null label is no click. Rows with a null id that agree in entity and
    day count once. The rows are spread by id before anything is counted, so a hot entity never meets one task, and the
    counts by day are combined before their shuffle.
    """
    rows = df.select(F.col(entity).alias("entity"), F.to_date(time).alias("day"), F.col(row_id).alias("id"), F.coalesce(F.col(label).cast("boolean"), F.lit(False)).alias("hit"))
    once = rows.where("entity is not null and day is not null").groupBy("id", "entity", "day").agg(F.max("hit").alias("hit"))
    return once.groupBy("entity", "day").agg(F.count("*").alias("inview"), F.sum(F.col("hit").cast("long")).alias("clicks"))


def trailing_sums(counts: DataFrame, windows: Sequence[int] = (7, 30), values: Sequence[str] = ("inview", "clicks")) -> DataFrame:
    """For each entity and every day from its first to its last: the day's values and `<value>_<n>`, the totals of the n days up to it.

    `counts` has one row per (entity, day). Days without a row count as 0, as do days before the first. Sums of 1, 2, 4,
    ... days come from one another by adding the block that lies as many days back; a window is then the sum of the
    blocks of its binary digits, laid end to end. An entity has at most one row a day here, so no group outgrows a task.
    """
    if any(n < 1 for n in windows):
        raise ValueError("a window has at least one day")
    w = W.partitionBy("entity").orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    dense = counts.select("entity", "day", *values, until.alias("until")).select("entity", F.explode(F.sequence("day", "until")).alias("at"), "day", *values)
    own = F.col("at") == F.col("day")
    dense = dense.select("entity", F.col("at").alias("day"), *(F.when(own, F.coalesce(v, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(v) for v in values))
    back = lambda c, days: F.coalesce(F.lag(c, days).over(w), F.lit(0)) if days else F.col(c)
    blocks = [2**i for i in range(max(windows).bit_length())]
    dense = dense.withColumns({f"_{v}_1": F.col(v) for v in values})
    for size in blocks[1:]:
        dense = dense.withColumns({f"_{v}_{size}": F.col(f"_{v}_{size // 2}") + back(f"_{v}_{size // 2}", size // 2) for v in values})

    def total(v: str, n: int) -> Column:
        parts, at = [], 0
        for size in reversed(blocks):
            if n & size:
                parts.append(back(f"_{v}_{size}", at))
                at += size
        return sum(parts[1:], parts[0])

    return dense.select("entity", "day", *values, *(total(v, n).alias(f"{v}_{n}") for n in windows for v in values))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Days within an article's life on which it was not shown but its clicks of the last week ran at twice the month's pace."""
    rolled = trailing_sums(daily_counts(table(spark, folder, "behaviour"), "article_idx", "time", "label", "pair_id"))
    hot = rolled.where("inview = 0 and clicks_7 >= 1 and 15 * clicks_7 >= 7 * clicks_30")
    return hot.select(F.col("entity").alias("article_idx"), F.date_format("day", "yyyy-MM-dd").alias("day"))


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and daily averages of exposures and clicks over 7 and 30 days, for every article and day."""
    rolled = trailing_sums(daily_counts(table(spark, folder, "behaviour"), "article_idx", "time", "label", "pair_id"))
    sums = [F.col(f"{v}_{n}").alias(f"roll_{v}_{n}") for n in (7, 30) for v in ("inview", "clicks")]
    means = [F.round(F.col(f"{v}_{n}") / n, 6).alias(f"mean_{v}_{n}") for n in (7, 30) for v in ("inview", "clicks")]
    return rolled.select(F.col("entity").alias("article_idx"), F.date_format("day", "yyyy-MM-dd").alias("day"), *sums, *means)


QUERIES = {"p2_found": p2_found, "p2_rolling": p2_rolling}

_ROLLED = """
WITH once AS (SELECT DISTINCT pair_id, article_idx, CAST(time AS DATE) AS day, label FROM behaviour WHERE time IS NOT NULL AND article_idx IS NOT NULL),
d AS (SELECT article_idx, day, count(*) AS inview, sum(CASE WHEN label THEN 1 ELSE 0 END) AS clicks FROM once GROUP BY 1, 2),
life AS (SELECT article_idx, min(day) AS a, max(day) AS b FROM d GROUP BY 1),
grid AS (SELECT article_idx, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM life),
f AS (SELECT g.article_idx, g.day, coalesce(d.inview, 0) AS inview, coalesce(d.clicks, 0) AS clicks FROM grid g LEFT JOIN d ON d.article_idx = g.article_idx AND d.day = g.day),
r AS (SELECT *, sum(inview) OVER w7 AS i7, sum(clicks) OVER w7 AS c7, sum(inview) OVER w30 AS i30, sum(clicks) OVER w30 AS c30 FROM f
      WINDOW w7 AS (PARTITION BY article_idx ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW),
             w30 AS (PARTITION BY article_idx ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))
"""

ORACLES = {
    "p2_found": _ROLLED + "SELECT article_idx, strftime(day, '%Y-%m-%d') AS day FROM r WHERE inview = 0 AND c7 >= 1 AND 15 * c7 >= 7 * c30",
    "p2_rolling": _ROLLED + """SELECT article_idx, strftime(day, '%Y-%m-%d') AS day, CAST(i7 AS BIGINT) AS roll_inview_7, CAST(c7 AS BIGINT) AS roll_clicks_7,
        CAST(i30 AS BIGINT) AS roll_inview_30, CAST(c30 AS BIGINT) AS roll_clicks_30, round(i7 / 7.0, 6) AS mean_inview_7, round(c7 / 7.0, 6) AS mean_clicks_7,
        round(i30 / 30.0, 6) AS mean_inview_30, round(c30 / 30.0, 6) AS mean_clicks_30 FROM r""",
}
