"""Candidate generation: universes, baselines, fusion of retrievers, what was read, and recall of what was clicked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.features import article_features, exposures
from clicklake.operators.lists import UNIFORM_SQL, dense_ids, uniform
from clicklake.sources.logs import ARTICLES, CLICKS, CUTOFF, HISTORY, IMP, articles, at, clicks, histories, history_clicks, impressions
from clicklake.sources.tables import table

RRF = 60


def candidate_universe(article: DataFrame, start: Column, end: Column, days: int | None) -> DataFrame:
    """Articles dated (published, else first seen) from `days` before the split's start to its end, both included; all for None."""
    dated = F.coalesce("published_time", "first_seen_time")
    if days is None:
        return article
    return article.where((dated >= F.timestamp_add("DAY", F.lit(-days), start)) & (dated <= end))


def cold_start(users: DataFrame, threshold: int = 5) -> DataFrame:
    """(user_idx, is_cold): fewer history clicks than the threshold; no history counts as none."""
    return users.select("user_idx", (F.coalesce("n_hist", F.lit(0)) < threshold).alias("is_cold"))


def top_rows(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The k first rows of each user by the given order, with their rank."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("user_idx").orderBy(*order))).where(F.col("rank") <= k)


def random_topk(users: DataFrame, universe: DataFrame, k: int, seed: int = 3, draws: int = 8) -> DataFrame:
    """(user_idx, article_idx, rank): k distinct articles for each user (all, if there are fewer), drawn by hashes of the ids alone.

    The universe is numbered, and each of `draws` x k draws of a user names a number; the first k distinct ones stay. So the
    work is users x k, never users x universe. Users left short, which only a universe hardly larger than k leaves, are filled
    up: the universe, if under `draws` x k articles, is gone through in the order of its hashes with the user.
    """
    numbered = dense_ids(universe, "idx").select(F.col("key").cast("bigint").alias("article_idx"), F.col("id").alias("no"))
    size = numbered.agg(F.count("*").alias("n"))
    people = users.where("user_idx is not null").select("user_idx").distinct()
    rows = people.select("user_idx", F.explode(F.sequence(F.lit(0), F.lit(draws * k - 1))).alias("i"))
    rows = rows.crossJoin(F.broadcast(size)).withColumn("no", F.floor(uniform(F.col("user_idx"), F.col("i"), seed) * F.col("n")))
    met = rows.groupBy("user_idx", "no").agg(F.min("i").cast("double").alias("i")).join(numbered, "no").select("user_idx", "article_idx", "i")
    short = people.join(met.groupBy("user_idx").agg(F.count("*").alias("got")), "user_idx", "left").where(F.coalesce("got", F.lit(0)) < k).select("user_idx")
    few = numbered.crossJoin(F.broadcast(size)).where(F.col("n") < draws * k).agg(F.collect_list("article_idx").alias("every"))  # under draws x k ids, or none
    rest = short.crossJoin(F.broadcast(few)).select("user_idx", F.explode("every").alias("article_idx")).join(met, ["user_idx", "article_idx"], "left_anti")
    filled = met.unionByName(rest.withColumn("i", draws * k + uniform(F.col("user_idx"), F.col("article_idx"), seed + 1)))
    return top_rows(filled, k, F.col("i"), F.col("article_idx")).select("user_idx", "article_idx", "rank")


def global_ranking(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """(article_idx, rank): one list of k articles for everyone, k being small."""
    first = scored.orderBy(*order).limit(k)
    return first.select("article_idx", F.row_number().over(W.orderBy(*order)).alias("rank"))


def drop_seen(candidates: DataFrame, seen: DataFrame) -> DataFrame:
    """Candidates less those (user_idx, article_idx) of `seen`: an anti join before any cut, so no over-fetching."""
    return candidates.join(seen.select("user_idx", "article_idx"), ["user_idx", "article_idx"], "left_anti")


def rrf(lists: DataFrame, source: str, k: int | None, constant: int = RRF) -> DataFrame:
    """(user_idx, article_idx, score, rank): sum over sources of 1 / (constant + rank there), the k best or, for None, all without
    a rank; equal ones by id.

    `lists` has user_idx, article_idx, `source`, score; ranks within (user, source) run by score, then id. Rows with a null
    user, article, source or score, or a NaN score, are left out; the same article counts once per source, at its best.
    """
    rows = lists.where(f"user_idx is not null and article_idx is not null and {source} is not null and score is not null and not isnan(score)")
    rows = rows.groupBy("user_idx", source, "article_idx").agg(F.max(F.col("score") + 0.0).alias("score"))
    ranked = ranked_in_slices(rows, ("user_idx", source), "score", "article_idx", "_rank")
    fused = ranked.groupBy("user_idx", "article_idx").agg(F.round(F.sum(1 / (constant + F.col("_rank"))), 12).alias("score"))
    return fused if k is None else top_rows(fused, k, F.desc("score"), F.col("article_idx"))


def ranked_in_slices(rows: DataFrame, group: tuple[str, ...], score: str, tie: str, name: str, slices: int = 64) -> DataFrame:
    """Adds `name`: the row's number in its group by falling score, then `tie`, without one task sorting a whole group.

    Approximate quantiles of a group's scores cut it into slices; a slice's numbers start where the slices of higher scores
    end. Any quantiles give the same numbers; good ones make the slices even. One score that fills several slices stays one.
    """
    edges = rows.groupBy(*group).agg(F.percentile_approx(score, F.array(*(F.lit(i / slices) for i in range(1, slices))), F.lit(1000)).alias("_edges"))
    cut_ = rows.join(edges, list(group)).withColumn("_slice", F.size(F.filter("_edges", lambda e: e > F.col(score)))).drop("_edges")
    sizes = cut_.groupBy(*group, "_slice").agg(F.count("*").alias("_n"))
    before = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*group, "_slice").orderBy(F.desc(score), tie))
    return cut_.withColumn(name, inside).join(before, [*group, "_slice"]).withColumn(name, F.col(name) + F.col("_before")).drop("_slice", "_before")


def recall_at(lists: DataFrame, imp: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """(imp, clicked, recall_<k>): share of an impression's distinct clicks within its user's k first; 0 for users without a list.

    Impressions without a click or a user are left out.
    """
    clicked = imp.where("user_idx is not null").select(F.col("src_row").alias("imp"), "user_idx", F.explode(F.array_distinct("clicked")).alias("article_idx")).where("article_idx is not null")
    met = clicked.join(lists.select("user_idx", "article_idx", "rank"), ["user_idx", "article_idx"], "left")
    return met.groupBy("imp").agg(F.count("*").alias("clicked"), *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"recall_{k}") for k in ks))


def retrieved_pairs(lists: DataFrame, imp: DataFrame, union_clicked: bool = True) -> DataFrame:
    """(imp, user_idx, article_idx, score, label, was_shown, n_list): every impression with its user's list, and missed clicks at score 0 if asked."""
    rows = imp.where("user_idx is not null").select(F.col("src_row").alias("imp"), "user_idx", "candidates", F.coalesce("clicked", F.array().cast("array<bigint>")).alias("clicked"))
    got = rows.join(lists.select("user_idx", "article_idx", "score"), "user_idx").select("imp", "user_idx", "article_idx", "score")
    if union_clicked:
        missed = rows.select("imp", "user_idx", F.explode(F.array_distinct("clicked")).alias("article_idx")).where("article_idx is not null").join(got, ["imp", "article_idx"], "left_anti")
        got = got.unionByName(missed.withColumn("score", F.lit(0.0)))
    has = lambda c: F.coalesce(F.array_contains(c, F.col("article_idx")), F.lit(False))
    out = got.join(rows.select("imp", "candidates", "clicked"), "imp")
    return out.select("imp", "user_idx", "article_idx", "score", has("clicked").alias("label"), has("candidates").alias("was_shown"), F.count("*").over(W.partitionBy("imp")).alias("n_list"))


def stage1_recall(pairs: DataFrame, imp: DataFrame) -> DataFrame:
    """One row: impressions, those with a click, the mean share of clicks retrieved, and the share of impressions with none."""
    hits = pairs.where("score > 0 and label").groupBy("imp").agg(F.count("*").alias("hits"))
    truth = pairs.select("imp").distinct().join(imp.select(F.col("src_row").alias("imp"), F.greatest(F.coalesce(F.size("clicked"), F.lit(0)), F.lit(0)).alias("clicked")), "imp").join(hits, "imp", "left")
    ok = F.col("clicked") > 0
    hits = F.coalesce("hits", F.lit(0))
    return truth.agg(F.count("*").alias("impressions"), F.count_if(ok).alias("with_click"), F.avg(F.when(ok, hits / F.col("clicked"))).alias("recall"), F.avg(F.when(ok, (hits == 0).cast("double"))).alias("none_retrieved"))


def universe_ceiling(imp: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: the share of clicks inside the universe, averaged over impressions with a click."""
    clicked = imp.select(F.col("src_row").alias("imp"), F.explode("clicked").alias("article_idx")).where("article_idx is not null")
    inside = clicked.join(universe.select(F.col("idx").alias("article_idx"), F.lit(1).alias("inside")), "article_idx", "left")
    return inside.groupBy("imp").agg(F.avg(F.coalesce("inside", F.lit(0)).cast("double")).alias("share")).agg(F.avg("share").alias("ceiling"), F.count("*").alias("impressions"))


def overlap(lists: DataFrame, source: str, a: str, b: str, k: int = 10) -> DataFrame:
    """(user_idx, common): how many of the k first articles two retrievers share, for users both serve."""
    rows = lists.where(f"user_idx is not null and article_idx is not null and score is not null and not isnan(score) and {source} in ('{a}', '{b}')")
    rows = rows.groupBy("user_idx", source, "article_idx").agg(F.max(F.col("score") + 0.0).alias("score"))
    rows = rows.withColumn("r", F.row_number().over(W.partitionBy("user_idx", source).orderBy(F.desc("score"), "article_idx"))).where(F.col("r") <= k)
    both = rows.groupBy("user_idx", "article_idx").agg(F.count("*").alias("n"), F.collect_set(source).alias("s"))
    return both.groupBy("user_idx").agg(F.count_if(F.col("n") == 2).alias("common"), F.size(F.array_distinct(F.flatten(F.collect_set("s")))).alias("served")).where("served = 2").select("user_idx", "common")


# queries


def _test(spark, folder):
    return impressions(spark, folder, F.col("time") >= at(CUTOFF))


def _lists(spark, folder, k: int | None = 20):
    return rrf(table(spark, folder, "topk_scores"), "retriever", k)


def _universe(spark, folder, days=30):
    return candidate_universe(articles(spark, folder), at(CUTOFF), at("2024-10-17 00:00:00"), days)


def candidate_universe_q(spark, folder):
    return _universe(spark, folder).select("idx")


def cold_start_q(spark, folder):
    return cold_start(table(spark, folder, "user_history").groupBy("user_idx").agg(F.max("n_hist").alias("n_hist")))


def random_topk_q(spark, folder):
    """Five random articles of the universe for every user with a history."""
    return random_topk(histories(spark, folder).select("user_idx"), _universe(spark, folder), 5)


def popularity_ranking_q(spark, folder):
    imp = impressions(spark, folder)
    old = article_features(clicks(imp), exposures(imp.where(F.col("time") < at(CUTOFF))), CUTOFF).withColumn("score", F.round("clicks_decayed", 9)).where("score > 0")
    kept = old.join(_universe(spark, folder).select(F.col("idx").alias("article_idx")), "article_idx", "left_semi")
    return global_ranking(kept, 50, F.desc("score"), F.col("article_idx"))


def recency_ranking_q(spark, folder):
    dated = _universe(spark, folder).select(F.col("idx").alias("article_idx"), F.coalesce("published_time", "first_seen_time").alias("t")).where(F.col("t") < at(CUTOFF))
    return global_ranking(dated, 50, F.desc("t"), F.col("article_idx"))


def broadcast_ranking_q(spark, folder):
    """The ten most popular articles for every user with a history: ten rows repeated."""
    ten = popularity_ranking_q(spark, folder).where("rank <= 10")
    return histories(spark, folder).select("user_idx").crossJoin(F.broadcast(ten))


def drop_seen_q(spark, folder):
    seen = history_clicks(histories(spark, folder)).select("user_idx", "article_idx").distinct()
    return top_rows(drop_seen(_lists(spark, folder, None), seen), 10, F.desc("score"), F.col("article_idx")).select("user_idx", "article_idx", "rank")


def rrf_q(spark, folder):
    return _lists(spark, folder).withColumn("score", F.round("score", 9))


def recall_q(spark, folder):
    got = recall_at(_lists(spark, folder), _test(spark, folder))
    return got.withColumns({c: F.round(c, 6) for c in ("recall_5", "recall_10")})


def lift_vs_random_q(spark, folder):
    """Mean recall of the fused lists over that of a random list of the same length, floored."""
    got = recall_at(_lists(spark, folder), _test(spark, folder), (20,)).agg(F.avg("recall_20").alias("recall"))
    chance = articles(spark, folder).agg((20 / F.count("*")).alias("chance"))
    return got.crossJoin(F.broadcast(chance)).select(F.round("recall", 6).alias("recall"), F.round(F.col("recall") / F.greatest("chance", F.lit(1e-9)), 4).alias("lift"))


def retrieved_pairs_q(spark, folder):
    return retrieved_pairs(_lists(spark, folder, 10), _test(spark, folder)).withColumn("score", F.round("score", 9))


def stage1_recall_q(spark, folder):
    got = stage1_recall(retrieved_pairs(_lists(spark, folder), _test(spark, folder), False), _test(spark, folder))
    return got.withColumns({c: F.round(c, 6) for c in ("recall", "none_retrieved")})


def universe_ceiling_q(spark, folder):
    return universe_ceiling(_test(spark, folder), _universe(spark, folder)).withColumn("ceiling", F.round("ceiling", 6))


def window_sweep_q(spark, folder):
    """Size and ceiling of universes of several widths, computed in one pass over the clicks."""
    every = None
    for days in (1, 3, 7, 14, 30, None):
        u = _universe(spark, folder, days)
        one = universe_ceiling(_test(spark, folder), u).crossJoin(u.agg(F.count("*").alias("size"))).select(F.lit(days or 0).alias("days"), "size", F.round("ceiling", 6).alias("ceiling"))
        every = one if every is None else every.unionByName(one)
    return every


def retriever_overlap_q(spark, folder):
    return overlap(table(spark, folder, "topk_scores"), "retriever", "bm25", "dense")


def best_per_key_q(spark, folder):
    rows = table(spark, folder, "topk_scores").where("user_idx is not null and article_idx is not null and score is not null and not isnan(score)")
    return rows.groupBy("user_idx", "article_idx").agg(F.max(F.col("score") + 0.0).alias("score"), F.count("*").alias("rows"))


QUERIES = {
    "candidate_universe": candidate_universe_q, "cold_start_mask": cold_start_q, "random_topk": random_topk_q, "popularity_ranking": popularity_ranking_q, "recency_ranking": recency_ranking_q, "broadcast_ranking": broadcast_ranking_q,
    "drop_seen": drop_seen_q, "rrf": rrf_q, "recall_at_k": recall_q, "lift_vs_random": lift_vs_random_q, "retrieved_pairs": retrieved_pairs_q, "stage1_recall": stage1_recall_q, "universe_ceiling": universe_ceiling_q,
    "window_sweep": window_sweep_q, "retriever_overlap": retriever_overlap_q, "best_per_key": best_per_key_q,
}

_T0 = f"TIMESTAMP '{CUTOFF}'"


def _uni(name: str, days: int | None) -> str:
    rule = f"WHERE coalesce(published_time, first_seen_time) >= {_T0} - INTERVAL {days} DAY AND coalesce(published_time, first_seen_time) <= TIMESTAMP '2024-10-17'" if days else ""
    return f"{name} AS (SELECT * FROM art {rule})"


_BEST = """best AS (SELECT user_idx, retriever, article_idx, max(score + 0.0) AS s FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND retriever IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2, 3),
rr AS (SELECT *, row_number() OVER (PARTITION BY user_idx, retriever ORDER BY s DESC, article_idx) AS r FROM best),
fused AS (SELECT user_idx, article_idx, round(sum(1.0 / (60 + r)), 12) AS score FROM rr GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS rank FROM fused)"""
_TEST = f"{IMP}, tst AS (SELECT * FROM imp WHERE time >= {_T0})"
_CL = "cl AS (SELECT DISTINCT src_row AS imp, user_idx, unnest(clicked) AS article_idx FROM tst WHERE user_idx IS NOT NULL)"
_POPR = f"""WITH {CLICKS}, {ARTICLES}, {_uni('u', 30)}, pc AS (SELECT article_idx, round(sum(pow(0.5, date_sub('second', ts, {_T0}) / 3600.0 / 24)), 9) AS s FROM clicks WHERE ts < {_T0} GROUP BY 1),
pop AS (SELECT article_idx, row_number() OVER (ORDER BY s DESC, article_idx) AS rank FROM pc JOIN u ON u.idx = pc.article_idx WHERE s > 0)"""

ORACLES = {
    "candidate_universe": f"WITH {ARTICLES}, {_uni('u', 30)} SELECT idx FROM u",
    "cold_start_mask": "SELECT user_idx, coalesce(max(n_hist), 0) < 5 AS is_cold FROM user_history GROUP BY 1",
    "random_topk": f"""WITH {ARTICLES}, {_uni('uu', 30)}, nb AS (SELECT idx, row_number() OVER (ORDER BY CAST(idx AS VARCHAR)) - 1 AS no, count(*) OVER () AS n FROM uu), us AS (SELECT DISTINCT user_idx FROM user_history WHERE user_idx IS NOT NULL),
        dr AS (SELECT user_idx, i, (SELECT max(n) FROM nb) AS n FROM us, range(40) t(i)), dd AS (SELECT user_idx, i, CAST(floor({UNIFORM_SQL.format(a='user_idx', b='i', seed=3)} * n) AS BIGINT) AS no FROM dr),
        f AS (SELECT user_idx, idx AS article_idx, CAST(min(i) AS DOUBLE) AS i FROM dd JOIN nb ON nb.no = dd.no GROUP BY 1, 2), sh AS (SELECT user_idx FROM us WHERE (SELECT count(*) FROM f WHERE f.user_idx = us.user_idx) < 5),
        fill AS (SELECT user_idx, idx AS article_idx FROM sh, nb WHERE n < 40 EXCEPT SELECT user_idx, article_idx FROM f), al AS (SELECT * FROM f UNION ALL SELECT user_idx, article_idx, 40 + {UNIFORM_SQL.format(a='user_idx', b='article_idx', seed=4)} FROM fill),
        r AS (SELECT user_idx, article_idx, row_number() OVER (PARTITION BY user_idx ORDER BY i, article_idx) AS rank FROM al) SELECT user_idx, article_idx, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5""",
    "popularity_ranking": _POPR + " SELECT article_idx, CAST(rank AS INT) AS rank FROM pop WHERE rank <= 50",
    "recency_ranking": f"WITH {ARTICLES}, {_uni('u', 30)}, d AS (SELECT idx AS article_idx, coalesce(published_time, first_seen_time) AS t FROM u) SELECT article_idx, CAST(row_number() OVER (ORDER BY t DESC, article_idx) AS INT) AS rank FROM d WHERE t < {_T0} QUALIFY rank <= 50",
    "broadcast_ranking": _POPR + " SELECT user_idx, article_idx, CAST(rank AS INT) AS rank FROM (SELECT DISTINCT user_idx FROM user_history), pop WHERE rank <= 10",
    "drop_seen": f"WITH {_BEST}, {HISTORY}, k AS (SELECT * FROM fr WHERE NOT EXISTS (SELECT 1 FROM hist_clicks h WHERE h.user_idx = fr.user_idx AND h.article_idx = fr.article_idx)) SELECT user_idx, article_idx, CAST(row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS INT) AS rank FROM k QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) <= 10",
    "rrf": f"WITH {_BEST} SELECT user_idx, article_idx, round(score, 9) AS score, CAST(rank AS INT) AS rank FROM fr WHERE rank <= 20",
    "recall_at_k": f"WITH {_BEST}, {_TEST}, {_CL} SELECT imp, count(*) AS clicked, round(count(*) FILTER (rank <= 5) / count(*), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / count(*), 6) AS recall_10 FROM cl LEFT JOIN fr ON fr.user_idx = cl.user_idx AND fr.article_idx = cl.article_idx AND rank <= 20 WHERE cl.article_idx IS NOT NULL GROUP BY 1",
    "lift_vs_random": f"WITH {_BEST}, {_TEST}, {_CL}, g AS (SELECT imp, count(*) FILTER (rank <= 20) / count(*) AS r FROM cl LEFT JOIN fr ON fr.user_idx = cl.user_idx AND fr.article_idx = cl.article_idx WHERE cl.article_idx IS NOT NULL GROUP BY 1) SELECT round(avg(r), 6) AS recall, round(avg(r) / greatest(20.0 / (SELECT count(DISTINCT idx) FROM articles), 1e-9), 4) AS lift FROM g",
    "retrieved_pairs": f"""WITH {_BEST}, {_TEST}, {_CL}, got AS (SELECT src_row AS imp, t.user_idx, article_idx, score FROM tst t JOIN fr ON fr.user_idx = t.user_idx WHERE rank <= 10),
        al AS (SELECT * FROM got UNION ALL SELECT cl.imp, cl.user_idx, cl.article_idx, 0 FROM cl WHERE article_idx IS NOT NULL AND NOT EXISTS (SELECT 1 FROM got WHERE got.imp = cl.imp AND got.article_idx = cl.article_idx))
        SELECT al.imp, al.user_idx, al.article_idx, round(score, 9) AS score, coalesce(list_contains(clicked, al.article_idx), false) AS label, coalesce(list_contains(candidates, al.article_idx), false) AS was_shown, count(*) OVER (PARTITION BY al.imp) AS n_list FROM al JOIN tst ON tst.src_row = al.imp""",
    "stage1_recall": f"""WITH {_BEST}, {_TEST}, {_CL}, us AS (SELECT DISTINCT user_idx FROM fr), h AS (SELECT cl.imp, count(*) AS h FROM cl JOIN fr ON fr.user_idx = cl.user_idx AND fr.article_idx = cl.article_idx AND rank <= 20 GROUP BY 1),
        t AS (SELECT src_row, coalesce(len(clicked), 0) AS c, coalesce(h, 0) AS h FROM tst JOIN us ON us.user_idx = tst.user_idx LEFT JOIN h ON h.imp = src_row)
        SELECT count(*) AS impressions, count(*) FILTER (c > 0) AS with_click, round(avg(h / c) FILTER (c > 0), 6) AS recall, round(avg(CAST(h = 0 AS INT)) FILTER (c > 0), 6) AS none_retrieved FROM t""",
    "universe_ceiling": f"WITH {ARTICLES}, {_uni('u', 30)}, {_TEST}, c AS (SELECT src_row, unnest(clicked) AS a FROM tst), s AS (SELECT src_row, avg(CAST(u.idx IS NOT NULL AS INT)) AS s FROM c LEFT JOIN u ON u.idx = c.a WHERE a IS NOT NULL GROUP BY 1) SELECT round(avg(s), 6) AS ceiling, count(*) AS impressions FROM s",
    "window_sweep": f"WITH {ARTICLES}, {_TEST}, c AS (SELECT src_row, unnest(clicked) AS a FROM tst), " + ", ".join(_uni(f"u{d or 0}", d) for d in (1, 3, 7, 14, 30, None)) + " "
    + " UNION ALL ".join(f"SELECT CAST({d} AS INT) AS days, (SELECT count(*) FROM u{d}) AS size, round(avg(s), 6) AS ceiling FROM (SELECT src_row, avg(CAST(u.idx IS NOT NULL AS INT)) AS s FROM c LEFT JOIN u{d} u ON u.idx = c.a WHERE a IS NOT NULL GROUP BY 1)" for d in (1, 3, 7, 14, 30, 0)),
    "retriever_overlap": f"WITH {_BEST}, t AS (SELECT * FROM rr WHERE r <= 10 AND retriever IN ('bm25', 'dense')), s AS (SELECT user_idx FROM t GROUP BY 1 HAVING count(DISTINCT retriever) = 2) SELECT s.user_idx, count(b.article_idx) AS common FROM s JOIN t a ON a.user_idx = s.user_idx AND a.retriever = 'bm25' LEFT JOIN t b ON b.user_idx = a.user_idx AND b.article_idx = a.article_idx AND b.retriever = 'dense' GROUP BY 1",
    "best_per_key": "SELECT user_idx, article_idx, max(score + 0.0) AS score, count(*) AS rows FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2",
}
