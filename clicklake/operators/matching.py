"""Signals between a user and a candidate, samples of negatives, and single metrics and expressions under their own names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.evaluation import ORACLES as _EVALUATION
from clicklake.operators.evaluation import _SCORED, popular_scores, rank_metrics, tie_ranked
from clicklake.operators.lexical import article_index, history_queries, score_pairs, tokens
from clicklake.operators.lexical import ORACLES as _LEXICAL
from clicklake.operators.lists import UNIFORM_SQL, uniform
from clicklake.operators.vectors import _UV, _V, _article_vectors, best_read, dot, knn_exact, norm, unit, user_vectors
from clicklake.operators.vectors import ORACLES as _VECTORS
from clicklake.plans.cut import cut
from clicklake.sources.logs import ARTICLES, HISTORY, PAIRS, articles, histories, history_clicks, impressions, pair_table


def matching_features(pairs: DataFrame, history: DataFrame, vectors: DataFrame, queries: DataFrame, weights: DataFrame, halflife: float = 10.0) -> DataFrame:
    """(user_idx, article_idx, bm25, emb_cos, emb_recent, emb_max) of the distinct pairs; 0 where user or article is unknown.

    Vectors travel with pairs of known articles only, raw with their length beside them.
    """
    pairs = pairs.select("user_idx", "article_idx").where("user_idx is not null and article_idx is not null").distinct()
    known = pairs.join(vectors.select("article_idx", "vector", F.greatest(norm(F.col("vector")), F.lit(1e-12)).alias("n")), "article_idx").select("user_idx", "article_idx", "vector", "n")
    cosine = lambda c: dot(F.col("vector"), F.col(c)) / F.col("n")
    mean = user_vectors(history, vectors).withColumnRenamed("vector", "mean")
    recent = user_vectors(history, vectors, halflife).withColumnRenamed("vector", "recent")
    best = best_read(pairs, history, vectors).withColumnRenamed("best", "emb_max")
    users = mean.join(recent, "user_idx", "full")
    cosines = known.join(users, "user_idx").select("user_idx", "article_idx", cosine("mean").alias("emb_cos"), cosine("recent").alias("emb_recent"))
    bm25 = score_pairs(pairs.select("user_idx", F.col("article_idx").alias("doc_id")), queries, weights).select("user_idx", F.col("doc_id").alias("article_idx"), F.col("score").alias("bm25"))
    out = pairs
    for part in (bm25, cosines, best):
        out = out.join(part, ["user_idx", "article_idx"], "left")
    return out.select("user_idx", "article_idx", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bm25", "emb_cos", "emb_recent", "emb_max")))


def slates(pairs: DataFrame, negatives: int = 4, seed: int = 23) -> DataFrame:
    """(imp, positive, negative, place): for every click the non-clicks of its impression with the smallest draws, up to so many.

    Draws depend on (impression, article) alone. A click in a list without non-clicks gives no row.
    """
    rest = pairs.where(~F.col("label")).select("imp", F.col("article_idx").alias("negative")).distinct()
    rest = rest.withColumn("place", F.row_number().over(W.partitionBy("imp").orderBy(uniform(F.col("imp"), F.col("negative"), seed), "negative"))).where(F.col("place") <= negatives)
    return pairs.where("label").select("imp", F.col("article_idx").alias("positive")).distinct().join(rest, "imp")


def interests(history: DataFrame, vectors: DataFrame, k: int = 3, rounds: int = 5) -> DataFrame:
    """(user_idx, interest, vector): spherical k-means over the vectors of the articles a user read, at most k centres.

    One user's vectors meet in one task; they are as many as the list in the user's own row of `history`. First centres are
    reads spread evenly over it.
    """
    rows = history_clicks(history).join(vectors, "article_idx").select("user_idx", "i", unit(F.col("vector")).alias("v"))

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part.sort_values("i")["v"].tolist())
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            c = np.array([x[near == j].mean(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        return pd.DataFrame({"user_idx": part["user_idx"].iloc[0], "interest": np.arange(len(c)), "vector": list(c)})

    return rows.groupBy("user_idx").applyInPandas(cluster, "user_idx bigint, interest bigint, vector array<double>")


def coverage_interval(lists: DataFrame, catalogue: int, replicates: int = 100, seed: int = 9) -> DataFrame:
    """One row: coverage, and its percentile interval when impressions are drawn anew.

    An article is in a replicate if any of its impressions is drawn; each is drawn at least once with probability 1 - 1/e, by
    a hash of (impression, replicate). Counts combine per (replicate, article) before the shuffle.
    """
    drawn = lists.select("imp", "article_idx", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b")).where(F.pmod(F.xxhash64("imp", "b", F.lit(seed)), F.lit(1_000_000)) < 632_121)
    each = drawn.groupBy("b").agg((F.count_distinct("article_idx") / catalogue).alias("c"))
    whole = lists.agg((F.count_distinct("article_idx") / catalogue).alias("coverage"))
    return whole.crossJoin(each.agg(F.percentile("c", F.lit(0.025)).alias("low"), F.percentile("c", F.lit(0.975)).alias("high")))


# queries


def _users(spark, folder):
    return histories(spark, folder).where("user_idx % 50 = 0")


def matching_features_q(spark, folder):
    """For every user, on all they were shown."""
    i = article_index(spark, folder)
    shown = pair_table(impressions(spark, folder, "user_idx is not null"))
    history = histories(spark, folder)
    got = matching_features(shown, history, _article_vectors(spark, folder), history_queries(history, i.postings), i.weights())
    return got.select("user_idx", "article_idx", *(F.round(c, 4).alias(c) for c in ("bm25", "emb_cos", "emb_recent", "emb_max")))


def emb_recent_q(spark, folder):
    users = user_vectors(histories(spark, folder), _article_vectors(spark, folder), 10.0)
    return users.select("user_idx", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[63], 5).alias("last"))


def dense_matmul_q(spark, folder):
    """The ten articles nearest to each user's vector, for the stated query set."""
    users = user_vectors(_users(spark, folder), _article_vectors(spark, folder)).select(F.col("user_idx").alias("id"), "vector")
    return knn_exact(users, _article_vectors(spark, folder).withColumnRenamed("article_idx", "id"), 10).select(F.col("query").alias("user_idx"), F.col("item").alias("article_idx"), F.round("score", 4).alias("score"), "rank")


def slates_q(spark, folder):
    return slates(pair_table(impressions(spark, folder)))


def interests_q(spark, folder):
    return interests(histories(spark, folder), _article_vectors(spark, folder)).select("user_idx", "interest", F.round(F.col("vector")[0], 5).alias("first"))


def coverage_ci_q(spark, folder):
    n = articles(spark, folder).count()
    return coverage_interval(cut(tie_ranked(popular_scores(spark, folder)).where("rank <= 10").select("imp", "article_idx"), "lists"), max(n, 1))


def tie_jitter_q(spark, folder):
    return tie_ranked(popular_scores(spark, folder)).select("imp", "position", "rank")


def _metric(*names):
    def query(spark, folder):
        return rank_metrics(popular_scores(spark, folder)).select("imp", *(F.round(c, 6).alias(c) for c in names))

    return query


def has_abstract_q(spark, folder):
    return articles(spark, folder).select("idx", (F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 0).alias("has_abstract"))


def position_frac_q(spark, folder):
    return pair_table(impressions(spark, folder)).select("imp", "position", F.round("position_frac", 9).alias("position_frac"))


def list_contains_q(spark, folder):
    return pair_table(impressions(spark, folder)).select("imp", "position", "label")


def stopwords_q(spark, folder):
    """How many tokens of each language the stop words take out."""
    docs, text = articles(spark, folder), F.expr("concat_ws(' ', title, abstract)")
    count = lambda stop: tokens(docs, "idx", text, F.col("lang"), stop).agg(F.count("*").alias("n"))
    return count(False).select(F.lit("all").alias("tokens"), "n").unionByName(count(True).select(F.lit("kept").alias("tokens"), "n"))


QUERIES = {
    "matching_features": matching_features_q, "emb_recent": emb_recent_q, "dense_matmul": dense_matmul_q, "slates": slates_q, "interests": interests_q, "coverage_ci": coverage_ci_q, "tie_jitter": tie_jitter_q, "mrr": _metric("mrr"),
    "mrr_first": _metric("mrr_first"), "ndcg_at_k": _metric("ndcg_5", "ndcg_10"), "hit_at_k": _metric("hit_5", "hit_10"), "has_abstract": has_abstract_q, "position_frac": position_frac_q, "list_contains": list_contains_q,
    "stopwords": stopwords_q,
}

_RANKED = _EVALUATION["rank_metrics"]
_RECENT = f"""{HISTORY}, {_V}, ag AS (SELECT *, pow(0.5, (max(i) OVER (PARTITION BY user_idx) - i) / 10.0) AS wgt FROM hist_clicks), ro AS (SELECT user_idx, wgt, unnest(e) / n AS x, unnest(range(64)) AS d FROM ag JOIN v ON vec_id = article_idx),
rm AS (SELECT user_idx, d, sum(wgt * x) / sum(wgt) AS x FROM ro GROUP BY 1, 2), rv AS (SELECT user_idx, list(x ORDER BY d) AS u, sqrt(sum(x * x)) AS ul FROM rm GROUP BY 1)"""
_WORD_COUNT = _LEXICAL["tokenize"]

ORACLES = {
    "matching_features": f"""WITH sh AS (SELECT DISTINCT user_idx, unnest(candidates) AS article_idx FROM impressions WHERE user_idx IS NOT NULL), bm AS ({_LEXICAL["score_pairs"].replace("round(coalesce(sum(q * w), 0), 5)", "round(coalesce(sum(q * w), 0), 4)")}),
        uv AS (WITH {_UV} SELECT * FROM uv), rv AS (WITH {_RECENT} SELECT * FROM rv), vv AS (WITH {_V} SELECT * FROM v), hc AS (WITH {HISTORY} SELECT DISTINCT user_idx, article_idx FROM hist_clicks),
        mx AS (SELECT sh.user_idx, sh.article_idx, max(list_cosine_similarity(a.e, b.e)) AS best FROM sh JOIN vv a ON a.vec_id = sh.article_idx JOIN hc ON hc.user_idx = sh.user_idx JOIN vv b ON b.vec_id = hc.article_idx GROUP BY 1, 2)
        SELECT sh.user_idx, sh.article_idx, coalesce(bm.score, 0) AS bm25, round(coalesce(list_cosine_similarity(uv.u, e), 0), 4) AS emb_cos, round(coalesce(list_cosine_similarity(rv.u, e), 0), 4) AS emb_recent, round(coalesce(best, 0), 4) AS emb_max FROM sh
        LEFT JOIN bm ON bm.user_idx = sh.user_idx AND bm.doc_id = sh.article_idx LEFT JOIN vv ON vec_id = sh.article_idx LEFT JOIN uv ON uv.user_idx = sh.user_idx LEFT JOIN rv ON rv.user_idx = sh.user_idx LEFT JOIN mx ON mx.user_idx = sh.user_idx AND mx.article_idx = sh.article_idx""",
    "emb_recent": f"WITH {_RECENT} SELECT user_idx, round(u[1] / ul, 5) AS first, round(u[64] / ul, 5) AS last FROM rv",
    "dense_matmul": f"WITH {_UV}, s AS (SELECT user_idx, vec_id AS article_idx, list_cosine_similarity(u, e) AS s FROM uv, v WHERE user_idx % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY round(s, 5) DESC, article_idx) AS rank FROM s) SELECT user_idx, article_idx, round(s, 4) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10",
    "slates": f"WITH {PAIRS}, n0 AS (SELECT DISTINCT imp, article_idx FROM pairs WHERE NOT label), n1 AS (SELECT *, {UNIFORM_SQL.format(a='imp', b='article_idx', seed=23)} AS u FROM n0), n2 AS (SELECT imp, article_idx AS negative, row_number() OVER (PARTITION BY imp ORDER BY u, article_idx) AS place FROM n1), p AS (SELECT DISTINCT imp, article_idx AS positive FROM pairs WHERE label) SELECT p.imp, positive, negative, CAST(place AS INT) AS place FROM p JOIN n2 ON n2.imp = p.imp WHERE place <= 4",
    "tie_jitter": _SCORED + " SELECT imp, CAST(position AS INT) AS position, CAST(rank AS INT) AS rank FROM rk",
    "mrr": f"SELECT imp, mrr FROM ({_RANKED})",
    "mrr_first": f"SELECT imp, mrr_first FROM ({_RANKED})",
    "ndcg_at_k": f"SELECT imp, ndcg_5, ndcg_10 FROM ({_RANKED})",
    "hit_at_k": f"SELECT imp, hit_5, hit_10 FROM ({_RANKED})",
    "has_abstract": f"WITH {ARTICLES} SELECT idx, length(trim(coalesce(abstract, ''))) > 0 AS has_abstract FROM art",
    "position_frac": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, round(position / greatest(n_candidates - 1, 1), 9) AS position_frac FROM pairs",
    "list_contains": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, label FROM pairs",
    "stopwords": _WORD_COUNT.replace(" SELECT term, count(*) AS n FROM tok GROUP BY 1", " SELECT 'kept' AS tokens, count(*) AS n FROM tok UNION ALL SELECT 'all', count(*) FROM tok_raw WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+')"),
}
