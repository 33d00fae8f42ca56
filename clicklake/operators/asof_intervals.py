"""Attributes as known at event time, by validity intervals cut into time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.functions.times import iso_to_utc, micros
from clicklake.plans.cut import cut
from clicklake.sources.tables import table


def validity(versions: DataFrame, entity: str, known: Column, order: Column) -> DataFrame:
    """(entity, since, until, best): the best version known in the microseconds [since, until); until is null for the last.

    A version is known strictly after `known`; of several known ones the largest `order` struct is best, however late a
    worse one becomes known. Versions with a null entity, `known` or first part of `order` are left out. Versions known at
    one instant are combined before the window, so only distinct change times of an entity are ever sorted.
    """
    rows = versions.select(F.col(entity).alias("entity"), (micros(known) + 1).alias("since"), order.alias("best")).where("entity is not null and since is not null")
    w = W.partitionBy("entity").orderBy("since")
    rows = rows.groupBy("entity", "since").agg(F.max("best").alias("best"))
    rows = rows.withColumn("best", F.max("best").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("old", F.lag("best").over(w)).where("old is null or old <> best")
    return rows.select("entity", "since", F.lead("since").over(w).alias("until"), "best")


def as_known(events: DataFrame, entity: str, time: str, event_id: str, intervals: DataFrame, bucket_seconds: int = 86_400, salts: int = 16, hot_share: float = 0.005) -> DataFrame:
    """(event_id, best) of each distinct event (id, entity, time) that has a version in `intervals` at its time.

    Events are first counted by (entity, time bucket). Intervals are cut at bucket edges, but only the buckets in which their
    entity has events come out; events meet them by (entity, bucket, salt) and lie in one half-open interval at most.
    Entities with more than `hot_share` of the events (there are at most 1/hot_share of them, so their list may go to the
    driver) are salted by event id and their intervals repeated. Events delivered again are dropped in the shuffle that the
    join needs anyway. Null ids count as one id.
    """
    width = bucket_seconds * 1_000_000
    bucket = lambda c: F.floor(c / width)
    rows = events.select(F.col(event_id).alias("id"), F.col(entity).alias("entity"), micros(F.col(time)).alias("t")).where("entity is not null and t is not null").withColumn("bucket", bucket(F.col("t")))
    counts = cut(rows.groupBy("entity", "bucket").agg(F.count("*").alias("n")), "buckets")
    least = F.lit(max(1.0, hot_share * (counts.agg(F.sum("n")).first()[0] or 0)))
    hot = [r[0] for r in counts.groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") > least).select("entity").collect()]
    is_hot = F.col("entity").isin(hot) if hot else F.lit(False)
    rows = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).otherwise(0))
    rows = rows.repartition("entity", "bucket", "salt").dropDuplicates(["entity", "bucket", "salt", "id", "t"])
    asked = counts.groupBy("entity").agg(F.collect_list("bucket").alias("asked"))  # as many as the log has buckets
    first, last = bucket(F.col("since")), F.coalesce(bucket(F.col("until") - 1), F.lit(2**62))
    spans = intervals.join(asked, "entity").withColumn("bucket", F.explode(F.filter("asked", lambda b: (b >= first) & (b <= last)))).drop("asked")
    spans = spans.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    met = rows.join(spans, ["entity", "bucket", "salt"]).where("t >= since and (until is null or t < until)")
    return met.select(F.col("id").alias("event_id"), "best")


def feature_intervals(features: DataFrame) -> DataFrame:
    """Validity of the article counters: known when both computed and loaded; best by computed, loaded, id."""
    # a generated column: filters on it stay above the parse, which would else be repeated in each of them
    computed = F.explode(F.array(iso_to_utc(F.col("computed_through")))).alias("computed")
    features = features.select("article_idx", "feat_id", "loaded_time", computed).where("computed is not null").withColumn("loaded", F.coalesce("loaded_time", "computed"))
    return validity(features, "article_idx", F.greatest("computed", "loaded"), F.struct("computed", "loaded", "feat_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The version of the article's counters that was known at each shown row."""
    found = as_known(table(spark, folder, "behaviour"), "article_idx", "time", "pair_id", feature_intervals(table(spark, folder, "article_features")))
    return found.select(F.col("event_id").alias("pair_id"), F.col("best.feat_id").alias("feat_id"))


QUERIES = {"p4_found": p4_found}

ORACLES = {
    "p4_found": """
WITH raw AS (SELECT feat_id, article_idx, loaded_time, trim(computed_through, E' \\t\\r\\n') AS s FROM article_features),
v AS (SELECT DISTINCT feat_id, article_idx, try_cast(regexp_replace(s, '(Z|[+-][0-9]{2}:[0-9]{2})$', '') AS TIMESTAMP)
        - CASE WHEN regexp_matches(s, '[+][0-9]{2}:[0-9]{2}$') THEN 1 WHEN regexp_matches(s, ':[0-9]{2}.*-[0-9]{2}:[0-9]{2}$') THEN -1 ELSE 0 END
          * CASE WHEN regexp_matches(s, '[+-][0-9]{2}:[0-9]{2}$') THEN CAST(right(s, 5)[1:2] AS INT) * INTERVAL 1 HOUR + CAST(right(s, 2) AS INT) * INTERVAL 1 MINUTE ELSE INTERVAL 0 HOUR END AS c,
        loaded_time FROM raw),
w AS (SELECT feat_id, article_idx, c, coalesce(loaded_time, c) AS l, greatest(c, coalesce(loaded_time, c)) AS k FROM v WHERE c IS NOT NULL),
b AS (SELECT DISTINCT pair_id, article_idx, time FROM behaviour WHERE time IS NOT NULL)
SELECT pair_id, arg_max(feat_id, (c, l, feat_id)) AS feat_id FROM b JOIN w ON w.article_idx = b.article_idx AND w.k < b.time GROUP BY pair_id""",
}
