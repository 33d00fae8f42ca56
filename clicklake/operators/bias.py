"""Position bias: click rates by position, plain, by list length, and with the article held fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.sources.logs import PAIRS, impressions, pair_table

MAX_POSITION = 40


def ctr_by_position(pairs: DataFrame, max_position: int = MAX_POSITION) -> DataFrame:
    """(position, n_shown, n_clicked, ctr) for positions below the limit."""
    seen = pairs.where(F.col("position") < max_position).groupBy("position").agg(F.count("*").alias("n_shown"), F.count_if("label").alias("n_clicked"))
    return seen.withColumn("ctr", F.col("n_clicked") / F.col("n_shown"))


def ctr_stratified(pairs: DataFrame, max_position: int = MAX_POSITION, least_lists: int = 500) -> DataFrame:
    """(position, ratio, n_shown, n_clicked, n_lengths): click rate over the mean rate of lists of the same length.

    Lengths seen in `least_lists` lists and clicked at all take part, each weighing as many slots as it gave.
    """
    per = pairs.where(F.col("position") < max_position).groupBy("n_candidates", "position").agg(F.count("*").alias("n_shown"), F.count_if("label").alias("n_clicked"))
    base = per.groupBy("n_candidates").agg(F.max("n_shown").alias("lists"), F.sum("n_clicked").alias("c"), F.sum("n_shown").alias("s")).where((F.col("lists") >= least_lists) & (F.col("c") > 0))
    met = per.join(base, "n_candidates").withColumn("ratio", F.col("n_clicked") / F.col("n_shown") / (F.col("c") / F.col("s")))
    return met.groupBy("position").agg((F.sum(F.col("ratio") * F.col("n_shown")) / F.sum("n_shown")).alias("ratio"), F.sum("n_shown").alias("n_shown"), F.sum("n_clicked").alias("n_clicked"), F.count_distinct("n_candidates").alias("n_lengths"))


def propensity(pairs: DataFrame, max_position: int = MAX_POSITION, least_shown: int = 50, least_positions: int = 2) -> DataFrame:
    """(position, propensity, n_articles, n_shown): the rate ratio with article and list length held fixed, 1 at the first position.

    (Article, length) pairs shown `least_shown` times, at `least_positions` positions, and clicked at all take part.
    """
    key = ["article_idx", "n_candidates"]
    per = pairs.where(F.col("position") < max_position).groupBy(*key, "position").agg(F.count("*").alias("n"), F.count_if("label").alias("c"))
    kept = per.groupBy(*key).agg(F.sum("n").alias("all_n"), F.sum("c").alias("all_c"), F.count("*").alias("places")).where((F.col("all_n") >= least_shown) & (F.col("places") >= least_positions) & (F.col("all_c") > 0))
    met = per.join(kept, key).withColumn("ratio", F.col("c") / F.col("n") / (F.col("all_c") / F.col("all_n")))
    curve = met.groupBy("position").agg((F.sum(F.col("ratio") * F.col("n")) / F.sum("n")).alias("raw"), F.count_distinct("article_idx").alias("n_articles"), F.sum("n").alias("n_shown"))
    top = curve.agg(F.min_by("raw", "position").alias("top"))  # one row per position: at most max_position rows
    return curve.crossJoin(F.broadcast(top)).select("position", (F.col("raw") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("propensity"), "n_articles", "n_shown")


def ipw_weights(curve: DataFrame, max_position: int = MAX_POSITION, clip: float = 0.1) -> DataFrame:
    """(position, weight) for every position below the limit: 1 / propensity, at most 1 / clip; gaps take the last value before."""
    every = curve.sparkSession.range(max_position).select(F.col("id").cast("int").alias("position"))
    good = curve.where("propensity > 0").select("position", "propensity")
    filled = F.coalesce(F.last("propensity", ignorenulls=True).over(W.orderBy("position")), F.lit(1.0))  # max_position rows
    return every.join(good, "position", "left").select("position", (1 / F.greatest(filled, F.lit(clip))).alias("weight"))


def position_report(pairs: DataFrame, max_position: int = MAX_POSITION, least_lists: int = 500, least_shown: int = 50) -> DataFrame:
    """One row: last over first value of the three curves, least and greatest stratified ratio, its largest deviation in standard errors."""
    ends = lambda v: F.max_by(v, "position") / F.nullif(F.min_by(v, "position"), F.lit(0.0))
    plain = ctr_by_position(pairs, max_position).agg(ends("ctr").alias("observed_decay"))
    strat = ctr_stratified(pairs, max_position, least_lists)
    base = strat.agg((F.sum("n_clicked") / F.sum("n_shown")).alias("base"))
    error = F.sqrt(F.col("base") * (1 - F.col("base")) / F.col("n_shown")) / F.col("base")
    z = F.max(F.abs(F.col("ratio") - 1) / error)
    strat = strat.crossJoin(F.broadcast(base)).agg(ends("ratio").alias("stratified_decay"), F.min("ratio").alias("ratio_min"), F.max("ratio").alias("ratio_max"), z.alias("max_z"))
    prop = propensity(pairs, max_position, least_shown).agg(F.max_by("propensity", "position").alias("propensity_decay"), F.max("n_articles").alias("n_articles"))
    return plain.crossJoin(strat).crossJoin(prop)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _pairs(spark, folder):
    return pair_table(impressions(spark, folder))


def ctr_by_position_q(spark, folder):
    return _rounded(ctr_by_position(_pairs(spark, folder)), "ctr")


def ctr_stratified_q(spark, folder):
    return _rounded(ctr_stratified(_pairs(spark, folder), least_lists=100), "ratio")


def propensity_q(spark, folder):
    return _rounded(propensity(_pairs(spark, folder)), "propensity")


def ipw_weights_q(spark, folder):
    return _rounded(ipw_weights(propensity(_pairs(spark, folder))), "weight")


def position_report_q(spark, folder):
    return _rounded(position_report(_pairs(spark, folder), least_lists=100), "observed_decay", "stratified_decay", "ratio_min", "ratio_max", "max_z", "propensity_decay")


def weighted_mean_q(spark, folder):
    rows = _pairs(spark, folder).groupBy("article_idx", "n_candidates").agg(F.count("*").alias("n"), F.avg(F.col("label").cast("double")).alias("r"))
    return _rounded(rows.groupBy("article_idx").agg((F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("rate"), F.sum("n").alias("n")), "rate")


QUERIES = {"ctr_by_position": ctr_by_position_q, "ctr_stratified": ctr_stratified_q, "propensity": propensity_q, "ipw_weights": ipw_weights_q, "position_report": position_report_q, "weighted_mean": weighted_mean_q}

_P = f"WITH {PAIRS}, pp AS (SELECT * FROM pairs WHERE position < 40)"
_CTR = ", ctr AS (SELECT position, count(*) AS n_shown, count(*) FILTER (label) AS n_clicked, avg(CAST(label AS INT)) AS ctr FROM pp GROUP BY 1)"
_STRAT = """, len_ok AS (SELECT n_candidates, avg(CAST(label AS INT)) AS base FROM pp GROUP BY 1 HAVING count(DISTINCT imp) >= 100 AND bool_or(label)),
ps AS (SELECT n_candidates, position, count(*) AS n, count(*) FILTER (label) AS c FROM pp GROUP BY 1, 2),
strat AS (SELECT position, sum(c / base) / sum(n) AS ratio, CAST(sum(n) AS BIGINT) AS n_shown, CAST(sum(c) AS BIGINT) AS n_clicked, count(*) AS n_lengths FROM ps JOIN len_ok USING (n_candidates) GROUP BY 1)"""
_PROP = """, art_ok AS (SELECT article_idx, n_candidates, avg(CAST(label AS INT)) AS base FROM pp GROUP BY 1, 2 HAVING count(*) >= 50 AND count(DISTINCT position) >= 2 AND bool_or(label)),
pa AS (SELECT article_idx, n_candidates, position, count(*) AS n, count(*) FILTER (label) AS c FROM pp GROUP BY 1, 2, 3),
raw AS (SELECT position, sum(c / base) / sum(n) AS raw, count(DISTINCT article_idx) AS n_articles, CAST(sum(n) AS BIGINT) AS n_shown FROM pa JOIN art_ok USING (article_idx, n_candidates) GROUP BY 1),
prop AS (SELECT position, raw / (SELECT CASE WHEN raw > 0 THEN raw ELSE 1 END FROM raw ORDER BY position LIMIT 1) AS propensity, n_articles, n_shown FROM raw)"""

ORACLES = {
    "ctr_by_position": _P + _CTR + " SELECT CAST(position AS INT) AS position, n_shown, n_clicked, round(ctr, 6) AS ctr FROM ctr",
    "ctr_stratified": _P + _STRAT + " SELECT CAST(position AS INT) AS position, round(ratio, 6) AS ratio, n_shown, n_clicked, n_lengths FROM strat",
    "propensity": _P + _PROP + " SELECT CAST(position AS INT) AS position, round(propensity, 6) AS propensity, n_articles, n_shown FROM prop",
    "ipw_weights": _P + _PROP + ", e AS (SELECT unnest(range(40)) AS position) SELECT CAST(position AS INT) AS position, round(1 / greatest(coalesce((SELECT propensity FROM prop WHERE prop.position <= e.position AND propensity > 0 ORDER BY prop.position DESC LIMIT 1), 1), 0.1), 6) AS weight FROM e",
    "position_report": _P + _CTR + _STRAT + _PROP + """, b AS (SELECT sum(n_clicked) / sum(n_shown) AS base FROM strat)
        SELECT (SELECT round(arg_max(ctr, position) / nullif(arg_min(ctr, position), 0), 6) FROM ctr) AS observed_decay, (SELECT round(arg_max(ratio, position) / nullif(arg_min(ratio, position), 0), 6) FROM strat) AS stratified_decay,
        (SELECT round(min(ratio), 6) FROM strat) AS ratio_min, (SELECT round(max(ratio), 6) FROM strat) AS ratio_max, (SELECT round(max(abs(ratio - 1) / (sqrt(base * (1 - base) / n_shown) / base)), 6) FROM strat, b) AS max_z,
        (SELECT round(arg_max(propensity, position), 6) FROM prop) AS propensity_decay, (SELECT max(n_articles) FROM prop) AS n_articles""",
    "weighted_mean": f"WITH {PAIRS} SELECT article_idx, round(avg(CAST(label AS INT)), 6) AS rate, count(*) AS n FROM pairs GROUP BY 1",
}
