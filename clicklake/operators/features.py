"""Aggregates of the click log before a cutoff: article, user and category features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.sources.logs import ARTICLES, CLICKS, CUTOFF, HISTORY, IMP, TEST_FROM, VAL_FROM, articles, at, clicks, histories, history_clicks, impressions
from clicklake.sources.tables import table


def hours(a: Column, b: Column) -> Column:
    """Hours from a to b; the difference is cut to whole seconds first."""
    return F.timestamp_diff("SECOND", a, b) / 3600


def exposures(imp: DataFrame) -> DataFrame:
    """(article_idx, n_inview): how often each article was shown."""
    return imp.select(F.explode("candidates").alias("article_idx")).where("article_idx is not null").groupBy("article_idx").agg(F.count("*").alias("n_inview"))


def split_of(time: Column) -> Column:
    """train, val or test by the half-open windows of the log; null for a null time."""
    return F.when(time < at(VAL_FROM), "train").when(time < at(TEST_FROM), "val").when(time.isNotNull(), "test")


def prior_exposures(imp: DataFrame, split: str) -> DataFrame:
    """Exposures of the splits that end before `split` begins, added up; none for the first."""
    by_split = imp.withColumn("split", split_of(F.col("time"))).where("split is not null")
    bounds = by_split.groupBy("split").agg(F.min("time").alias("first"), F.max("time").alias("last"))
    start = bounds.where(F.col("split") == split).select(F.col("first").alias("start"))
    earlier = bounds.crossJoin(F.broadcast(start)).where("last < start").select("split")
    return exposures(by_split.join(F.broadcast(earlier), "split", "left_semi"))


def popularity(click: DataFrame) -> DataFrame:
    """(article_idx, clicks, last_click)."""
    return click.groupBy("article_idx").agg(F.count("*").alias("clicks"), F.max("ts").alias("last_click"))


def article_features(click: DataFrame, shown: DataFrame, cutoff: str, halflife_hours: float = 24.0, smoothing: float = 100.0) -> DataFrame:
    """Clicks, decayed clicks, first and last click before the cutoff, raw and smoothed click rate of every article.

    A click one half-life old counts half. The smoothed rate leans towards the rate of the whole log, the raw one divides
    by one exposure at least. Articles shown but never clicked have 0 clicks, clicked but never shown 0 exposures.
    """
    weight = F.pow(F.lit(0.5), hours(F.col("ts"), at(cutoff)) / halflife_hours)
    seen = click.where(F.col("ts") < at(cutoff)).groupBy("article_idx").agg(F.count("*").alias("clicks"), F.sum(weight).alias("clicks_decayed"), F.max("ts").alias("last_click"), F.min("ts").alias("first_click"))
    both = shown.join(seen, "article_idx", "full").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_inview", "clicks", "clicks_decayed")})
    rate = both.agg((F.sum("clicks") / F.greatest(F.sum("n_inview"), F.lit(1))).alias("rate"))
    both = both.crossJoin(F.broadcast(rate))
    return both.select("article_idx", "n_inview", "clicks", "clicks_decayed", "first_click", "last_click", ((F.col("clicks") + smoothing * F.col("rate")) / (F.col("n_inview") + smoothing)).alias("ctr_smoothed"), (F.col("clicks") / F.greatest("n_inview", F.lit(1))).alias("ctr_raw"))


def category_profile(history: DataFrame, article: DataFrame) -> DataFrame:
    """(user_idx, topic, cat_clicks, cat_share): each user's clicks per category over the history."""
    counts = history_clicks(history).join(article.select(F.col("idx").alias("article_idx"), "topic"), "article_idx").where("topic is not null").groupBy("user_idx", "topic").agg(F.count("*").alias("cat_clicks"))
    return counts.withColumn("cat_share", F.col("cat_clicks") / F.sum("cat_clicks").over(W.partitionBy("user_idx")))


def user_features(history: DataFrame, click: DataFrame, article: DataFrame, cutoff: str) -> DataFrame:
    """Per user with a history: last click, clicks of the last day and week, top categories, their share, number and entropy.

    History and log clicks are both counted where they overlap. Users without dated clicks keep a null recency. Categories
    of equal count rank by name.
    """
    end = at(cutoff)
    dated = history_clicks(history).where("ts is not null").select("user_idx", "ts").unionByName(click.select("user_idx", "ts")).where(F.col("ts") < end)
    since = lambda days: F.count_if(F.col("ts") >= F.timestamp_add("DAY", F.lit(-days), end))
    recent = dated.groupBy("user_idx").agg(F.max("ts").alias("last_click"), since(1).alias("clicks_24h"), since(7).alias("clicks_7d")).withColumn("hours_since_last_click", hours(F.col("last_click"), end))
    share = F.col("cat_share")
    tops = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cat_clicks")).alias("n"), "topic"))), 1, 3), lambda x: x["topic"])
    profile = category_profile(history, article).groupBy("user_idx").agg(tops.alias("top_categories"), F.max(share).alias("top_category_share"), F.count("*").alias("n_categories"), (-F.sum(share * F.ln(share))).alias("category_entropy"))
    out = history.select("user_idx", "n_hist").join(recent, "user_idx", "left").join(profile, "user_idx", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("clicks_24h", "clicks_7d")})


def augmented_history(history: DataFrame, click: DataFrame, cutoff: str) -> DataFrame:
    """(user_idx, article_idx, ts): the history, then the user's clicks before the cutoff on articles not in it, oldest first.

    Both lists grow together; a missing time of a history click stays null.
    """
    known = F.coalesce("article_idx", F.array().cast("array<bigint>"))
    own = history.select("user_idx", F.transform(known, lambda x, i: F.struct(x.alias("article_idx"), F.get("ts", i).alias("ts"))).alias("old"))
    new = click.where(F.col("ts") < at(cutoff)).groupBy("user_idx", "article_idx").agg(F.min("ts").alias("ts"))
    added = new.groupBy("user_idx").agg(F.array_sort(F.collect_list(F.struct("ts", "article_idx"))).alias("new"))
    both = own.join(added, "user_idx", "left")
    fresh = F.filter(F.coalesce("new", F.expr("cast(array() as array<struct<ts:timestamp_ntz,article_idx:bigint>>)")), lambda x: ~F.exists("old", lambda y: y["article_idx"] == x["article_idx"]))
    every = F.concat("old", F.transform(fresh, lambda x: F.struct(x["article_idx"].alias("article_idx"), x["ts"].alias("ts"))))
    return both.select("user_idx", every["article_idx"].alias("article_idx"), every["ts"].alias("ts"))


def history_recency(history: DataFrame, halflife_hours: float = 24.0, newest_last: bool = True) -> DataFrame:
    """(user_idx, i, article_idx, hist_w): weight of each history click, halved for every half-life before the user's last.

    Whether times exist is asked of the data, user by user: users without any decay by rank instead, halved every ten
    places, the newest at the end unless told otherwise. A click without time among dated ones has a null weight.
    """
    rows, w = history_clicks(history), W.partitionBy("user_idx")
    age = F.max("i").over(w) - F.col("i") if newest_last else F.col("i")
    last = F.max("ts").over(w)
    weight = F.when(last.isNull(), F.pow(F.lit(0.5), age / 10)).otherwise(F.pow(F.lit(0.5), hours(F.col("ts"), last) / halflife_hours))
    return rows.select("user_idx", "i", "article_idx", weight.alias("hist_w"))


def category_recency(weights: DataFrame, article: DataFrame) -> DataFrame:
    """(user_idx, topic, cat_recency, cat_recency_share): decayed click mass per category and its share."""
    mass = weights.join(article.select(F.col("idx").alias("article_idx"), "topic"), "article_idx").where("topic is not null and hist_w is not null").groupBy("user_idx", "topic").agg(F.sum("hist_w").alias("cat_recency"))
    return mass.withColumn("cat_recency_share", F.col("cat_recency") / F.greatest(F.sum("cat_recency").over(W.partitionBy("user_idx")), F.lit(1e-9)))


# queries


def _shown_before(spark: SparkSession, folder: str) -> DataFrame:
    return exposures(impressions(spark, folder, F.col("time") < at(CUTOFF)))


def exposures_q(spark, folder):
    return exposures(impressions(spark, folder))


def prior_exposures_q(spark, folder):
    return prior_exposures(impressions(spark, folder), "test")


def clickstream_q(spark, folder):
    return clicks(impressions(spark, folder))


def popularity_q(spark, folder):
    return popularity(clicks(impressions(spark, folder)))


def article_features_q(spark, folder):
    out = article_features(clicks(impressions(spark, folder)), _shown_before(spark, folder), CUTOFF)
    return out.withColumns({c: F.round(c, 6) for c in ("clicks_decayed", "ctr_smoothed", "ctr_raw")})


def user_features_q(spark, folder):
    out = user_features(histories(spark, folder), clicks(impressions(spark, folder)), articles(spark, folder), CUTOFF)
    out = out.withColumn("top_categories", F.array_join("top_categories", ","))
    return out.withColumns({c: F.round(c, 6) for c in ("hours_since_last_click", "top_category_share", "category_entropy")})


def augmented_history_q(spark, folder):
    out = augmented_history(histories(spark, folder), clicks(impressions(spark, folder)), CUTOFF)
    return out.select("user_idx", F.array_join(F.col("article_idx").cast("array<string>"), ",").alias("article_idx"), F.size("ts").alias("n"), F.array_max("ts").alias("last"))


def article_stats_q(spark, folder):
    rows = impressions(spark, folder).select("time", F.explode("candidates").alias("article_idx"))
    return rows.where("article_idx is not null").groupBy("article_idx").agg(F.min("time").alias("first_seen_time"))


def time_bounds_q(spark, folder):
    rows = impressions(spark, folder).withColumn("split", split_of(F.col("time"))).where("split is not null")
    return rows.groupBy("split").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.count("*").alias("n"))


def history_longest_q(spark, folder):
    rows = table(spark, folder, "user_history").select("user_idx", "n_hist", F.coalesce(F.size("article_idx"), F.lit(0)).alias("n"))
    return rows.groupBy("user_idx").agg(F.max(F.struct("n", "n_hist")).alias("best")).select("user_idx", F.greatest("best.n", F.lit(0)).alias("n"))


def category_profile_q(spark, folder):
    return category_profile(histories(spark, folder), articles(spark, folder)).withColumn("cat_share", F.round("cat_share", 6))


def history_recency_q(spark, folder):
    return history_recency(histories(spark, folder)).withColumn("hist_w", F.round("hist_w", 6))


def category_recency_q(spark, folder):
    out = category_recency(history_recency(histories(spark, folder)), articles(spark, folder))
    return out.withColumns({c: F.round(c, 6) for c in ("cat_recency", "cat_recency_share")})


def distinct_agg_q(spark, folder):
    rows = impressions(spark, folder).select("user_idx", "device_type", F.explode("candidates").alias("article_idx"))
    return rows.where("user_idx is not null").groupBy("user_idx").agg(F.count_distinct("article_idx").alias("articles"), F.count_distinct("device_type").alias("devices"))


def ordered_list_agg_q(spark, folder):
    rows = clicks(impressions(spark, folder)).groupBy("user_idx").agg(F.array_sort(F.collect_list(F.struct("ts", "article_idx"))).alias("l"))
    return rows.select("user_idx", F.array_join(F.transform("l", lambda x: x["article_idx"].cast("string")), ",").alias("articles"))


QUERIES = {
    "exposures": exposures_q, "prior_exposures": prior_exposures_q, "clickstream": clickstream_q, "popularity": popularity_q, "article_features": article_features_q, "user_features": user_features_q,
    "augmented_history": augmented_history_q, "article_stats": article_stats_q, "time_bounds": time_bounds_q, "history_longest": history_longest_q, "category_profile": category_profile_q, "history_recency": history_recency_q,
    "category_recency": category_recency_q, "distinct_agg": distinct_agg_q, "ordered_list_agg": ordered_list_agg_q,
}

_END = f"TIMESTAMP '{CUTOFF}'"
_SPLIT = f"CASE WHEN time < TIMESTAMP '{VAL_FROM}' THEN 'train' WHEN time < TIMESTAMP '{TEST_FROM}' THEN 'val' WHEN time IS NOT NULL THEN 'test' END"
_PROFILE = f"{ARTICLES}, {HISTORY}, prof AS (SELECT user_idx, topic, count(*) AS n FROM hist_clicks h JOIN art ON art.idx = h.article_idx WHERE topic IS NOT NULL GROUP BY 1, 2), share AS (SELECT *, n / sum(n) OVER (PARTITION BY user_idx) AS s FROM prof)"
_WEIGHT = f"""{HISTORY}, l AS (SELECT *, max(ts) OVER (PARTITION BY user_idx) AS last, max(i) OVER (PARTITION BY user_idx) AS top FROM hist_clicks),
wgt AS (SELECT user_idx, i, article_idx, CASE WHEN last IS NULL THEN pow(0.5, (top - i) / 10.0) ELSE pow(0.5, date_sub('second', ts, last) / 3600.0 / 24) END AS w FROM l)"""

ORACLES = {
    "exposures": f"WITH {IMP}, o AS (SELECT unnest(candidates) AS article_idx FROM imp) SELECT article_idx, count(*) AS n_inview FROM o WHERE article_idx IS NOT NULL GROUP BY 1",
    "prior_exposures": f"WITH {IMP}, o AS (SELECT time, unnest(candidates) AS article_idx FROM imp) SELECT article_idx, count(*) AS n_inview FROM o WHERE article_idx IS NOT NULL AND time < {_END} GROUP BY 1",
    "clickstream": f"WITH {CLICKS} SELECT * FROM clicks",
    "popularity": f"WITH {CLICKS} SELECT article_idx, count(*) AS clicks, max(ts) AS last_click FROM clicks GROUP BY 1",
    "article_features": f"""WITH {CLICKS}, o AS (SELECT time, unnest(candidates) AS article_idx FROM imp), v AS (SELECT article_idx, count(*) AS n_inview FROM o WHERE article_idx IS NOT NULL AND time < {_END} GROUP BY 1),
        c AS (SELECT article_idx, count(*) AS clicks, sum(pow(0.5, date_sub('second', ts, {_END}) / 3600.0 / 24)) AS d, max(ts) AS last_click, min(ts) AS first_click FROM clicks WHERE ts < {_END} GROUP BY 1),
        b AS (SELECT coalesce(v.article_idx, c.article_idx) AS article_idx, coalesce(n_inview, 0) AS n_inview, coalesce(clicks, 0) AS clicks, coalesce(d, 0) AS d, first_click, last_click FROM v FULL JOIN c ON c.article_idx = v.article_idx),
        p AS (SELECT sum(clicks) / greatest(sum(n_inview), 1) AS prior FROM b)
        SELECT article_idx, n_inview, clicks, round(d, 6) AS clicks_decayed, first_click, last_click, round((clicks + 100 * prior) / (n_inview + 100), 6) AS ctr_smoothed, round(clicks / greatest(n_inview, 1), 6) AS ctr_raw FROM b, p""",
    "user_features": f"""WITH {CLICKS}, {_PROFILE}, ev AS (SELECT user_idx, ts FROM hist_clicks WHERE ts < {_END} UNION ALL SELECT user_idx, ts FROM clicks WHERE ts < {_END}),
        r AS (SELECT user_idx, max(ts) AS last_click, count(*) FILTER (ts >= {_END} - INTERVAL 1 DAY) AS d1, count(*) FILTER (ts >= {_END} - INTERVAL 7 DAY) AS d7 FROM ev GROUP BY 1),
        p AS (SELECT user_idx, array_to_string(list(topic ORDER BY n DESC, topic)[1:3], ',') AS top_categories, max(s) AS m, count(*) AS k, -sum(s * ln(s)) AS e FROM share GROUP BY 1)
        SELECT h.user_idx, h.n_hist, last_click, coalesce(d1, 0) AS clicks_24h, coalesce(d7, 0) AS clicks_7d, round(date_sub('second', last_click, {_END}) / 3600.0, 6) AS hours_since_last_click, top_categories, round(m, 6) AS top_category_share,
        k AS n_categories, round(e, 6) AS category_entropy FROM hist h LEFT JOIN r ON r.user_idx = h.user_idx LEFT JOIN p ON p.user_idx = h.user_idx""",
    "augmented_history": f"""WITH {CLICKS}, {HISTORY}, oldc AS (SELECT user_idx, unnest(range(len(article_idx))) AS i, unnest(article_idx) AS article_idx, ts AS times FROM hist),
        n AS (SELECT user_idx, article_idx, min(ts) AS ts FROM clicks WHERE ts < {_END} GROUP BY 1, 2),
        fresh AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM oldc WHERE oldc.user_idx = n.user_idx AND oldc.article_idx = n.article_idx)),
        every AS (SELECT user_idx, 0 AS part, i, article_idx, times[i + 1] AS ts FROM oldc UNION ALL SELECT user_idx, 1, row_number() OVER (PARTITION BY user_idx ORDER BY ts, article_idx), article_idx, ts FROM fresh)
        SELECT h.user_idx, coalesce(string_agg(CAST(e.article_idx AS VARCHAR), ',' ORDER BY part, i), '') AS article_idx, CAST(count(e.part) AS INT) AS n, max(e.ts) AS last FROM hist h LEFT JOIN every e ON e.user_idx = h.user_idx GROUP BY 1""",
    "article_stats": f"WITH {IMP}, o AS (SELECT time, unnest(candidates) AS article_idx FROM imp) SELECT article_idx, min(time) AS first_seen_time FROM o WHERE article_idx IS NOT NULL GROUP BY 1",
    "time_bounds": f"WITH {IMP} SELECT {_SPLIT} AS split, min(time) AS first, max(time) AS last, count(*) AS n FROM imp WHERE time IS NOT NULL GROUP BY 1",
    "history_longest": "SELECT user_idx, CAST(max(coalesce(len(article_idx), 0)) AS INT) AS n FROM user_history GROUP BY 1",
    "category_profile": f"WITH {_PROFILE} SELECT user_idx, topic, n AS cat_clicks, round(s, 6) AS cat_share FROM share",
    "history_recency": f"WITH {_WEIGHT} SELECT user_idx, CAST(i AS INT) AS i, article_idx, round(w, 6) AS hist_w FROM wgt",
    "category_recency": f"""WITH {_WEIGHT}, {ARTICLES}, m AS (SELECT user_idx, topic, sum(w) AS r FROM wgt JOIN art ON art.idx = wgt.article_idx WHERE topic IS NOT NULL AND w IS NOT NULL GROUP BY 1, 2)
        SELECT user_idx, topic, round(r, 6) AS cat_recency, round(r / greatest(sum(r) OVER (PARTITION BY user_idx), 1e-9), 6) AS cat_recency_share FROM m""",
    "distinct_agg": f"WITH {IMP}, o AS (SELECT user_idx, device_type, unnest(candidates) AS article_idx FROM imp) SELECT user_idx, count(DISTINCT article_idx) AS articles, count(DISTINCT device_type) AS devices FROM o WHERE user_idx IS NOT NULL GROUP BY 1",
    "ordered_list_agg": f"WITH {CLICKS} SELECT user_idx, string_agg(CAST(article_idx AS VARCHAR), ',' ORDER BY ts, article_idx) AS articles FROM clicks GROUP BY 1",
}
