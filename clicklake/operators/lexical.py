"""BM25 over postings kept as a table: tokens, vocabulary, weights, queries from histories, search and explanation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.functions.stems import danish, danish_sql
from clicklake.operators.blocks import POSTINGS, QUERY_ROWS, ahead, best, best_pruned, met, packed, paired, parts, span_sums, sure
from clicklake.plans.cut import cut
from clicklake.sources.logs import ARTICLES, HISTORY, IMP, TEST_FROM, VAL_FROM, articles, at, histories, history_clicks, impressions, pair_table

#: The stop words by language; any other language takes the English ones.
STOPWORDS = {
    "da": """og i på er til det at en den af for som med de der har var et han hun sig men om så fra ikke blev vi du jeg kan vil efter ved nu over
        være hans hendes man mig dig sin sit under mod eller når hvad hvor hvis skal bliver have her får""".split(),
    "en": """the a an and or of to in is it for on with as at by from that this was were be been are he she his her they them you your i we our
        but not have has had will would can could s t what when where who how why all out up about""".split(),
}
K1, B = 1.2, 0.75
SCORED = "user_idx bigint, doc_id bigint, score double"


def tokens(docs: DataFrame, doc_id: str, text: Column, lang: Column, stop: bool = True) -> DataFrame:
    """(doc_id, term): lower-cased text without punctuation, split at single spaces; two characters or more, no bare numbers, no stop words.

    Other white space stays inside a token, so a line end joins two words. A null text has no tokens.
    """
    words = F.explode(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), " "))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.lower(lang), F.lit("en")).alias("lang"), words.alias("term")).where((F.char_length("term") >= 2) & ~F.col("term").rlike("^[0-9]+$"))
    if stop:
        da, en = (F.col("term").isin(STOPWORDS[x]) for x in ("da", "en"))
        rows = rows.where(~F.when(F.col("lang") == "da", da).otherwise(en))
    return rows.select("doc_id", "term")


def stems(terms: DataFrame) -> DataFrame:
    """(term, stem) of each distinct Danish term, stemmed once."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        return words.map(danish)

    return terms.select("term").distinct().withColumn("stem", stem("term"))


def stemmed(rows: DataFrame, docs: DataFrame, doc_id: str, lang: Column) -> DataFrame:
    """Postings (doc_id, term, tf) with the terms of Danish documents replaced by their stems, counts of one stem added up."""
    danish_ = docs.select(F.col(doc_id).alias("doc_id"), (F.lower(lang) == "da").alias("da")).distinct()
    rows = cut(rows.join(danish_, "doc_id").select("doc_id", "term", "tf", F.coalesce("da", F.lit(False)).alias("da")), "unstemmed")
    met = rows.join(stems(rows.where("da")), "term", "left")
    return met.groupBy("doc_id", F.when(F.col("da"), F.coalesce("stem", "term")).otherwise(F.col("term")).alias("term")).agg(F.sum("tf").alias("tf"))


class Index:
    """Postings with everything BM25 asks of them; each table is one aggregation over the one before."""

    def __init__(self, docs: DataFrame, doc_id: str, text: Column, lang: Column, stop: bool = True, stem: bool = False):
        rows = tokens(docs, doc_id, text, lang, stop).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
        self.postings = cut(stemmed(rows, docs, doc_id, lang) if stem else rows, "postings")
        self.lengths = docs.select(F.col(doc_id).alias("doc_id")).distinct().join(self.postings.groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
        self.corpus = self.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))  # one row
        self.vocabulary = self.postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(self.corpus)).select("term", "df", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))

    def weights(self, k1: float = K1, b: float = B, delta: float | None = None) -> DataFrame:
        """(doc_id, term, tf, w): BM25, or BM25L with its shift `delta`; re-weighting needs no new tokens."""
        rows = self.postings.join(self.lengths, "doc_id").join(self.vocabulary, "term").crossJoin(F.broadcast(self.corpus))
        norm = 1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))
        if delta is None:
            w = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * norm)
        else:
            c = F.col("tf") / norm
            w = (k1 + 1) * (c + delta) / (k1 + c + delta)
        return rows.select("doc_id", "term", "tf", (w * F.col("idf")).alias("w"))


def history_queries(history: DataFrame, postings: DataFrame, last: int | None = None, halflife: float | None = None, newest: int | None = None) -> DataFrame:
    """(user_idx, term, q): the summed term counts of the articles a user read, all or the last ones, or weighted by rank of age.

    With `newest`, a column `q_newest` has the same over that many last articles, null where these lack the term.
    """
    rows = history_clicks(history)
    age = F.max("i").over(W.partitionBy("user_idx")) - F.col("i")
    rows = rows.withColumn("age", age)
    if last is not None:
        rows = rows.where(F.col("age") < last)
    weight, q = F.lit(1.0) if halflife is None else F.pow(F.lit(0.5), F.col("age") / halflife), F.col("wt") * F.col("tf")
    return rows.withColumn("wt", weight).join(postings, F.col("article_idx") == F.col("doc_id")).groupBy("user_idx", "term").agg(F.sum(q).alias("q"), *([] if newest is None else [F.sum(F.when(F.col("age") < newest, q)).alias("q_newest")]))


def saturated(q: Column, k3: float | None) -> Column:
    """(k3 + 1) q / (k3 + q); None leaves q as it is, 0 makes it binary."""
    return q if k3 is None else (k3 + 1) * q / (k3 + q)


def search(queries: DataFrame, weights: DataFrame, k: int = 10, universe: DataFrame | None = None) -> DataFrame:
    """(user_idx, doc_id, score, rank): the k best documents of each query by the sum of q x w over shared terms.

    Only documents that share a term appear; equal scores, to nine decimals, go to the smaller id. `universe` (doc_id)
    narrows the documents before they meet. Blocks of queries and of documents meet pair by pair, and only the bests of a pair
    become rows.
    """
    if universe is not None:
        weights = weights.join(universe, "doc_id", "left_semi")
    queries, weights = cut(queries, "queries"), cut(weights.select("doc_id", "term", "w"), "weights")
    scores = met(queries, parts(queries, QUERY_ROWS), weights, parts(weights, POSTINGS), F.col("doc_id"), best(k, 9), SCORED)
    return ranked(scores, k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("user_idx").orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def sure_scores(queries: DataFrame, weights: DataFrame, nq: int, nd: int, k: int, seeds: int) -> DataFrame:
    """(user_idx, edge): a score that k documents of each query are sure to reach; a query that fewer documents match has no row.

    The `seeds` terms of greatest bound name 4 k documents, whose scores are then counted in full; the edge is the k-th.
    """
    top = weights.groupBy("term").agg(F.max("w").alias("top"))
    order = F.row_number().over(W.partitionBy("user_idx").orderBy(F.desc(F.col("q") * F.col("top")), "term"))
    few = queries.join(top, "term").withColumn("r", order).where(F.col("r") <= seeds).select("user_idx", "term", "q")
    part = met(few, nq, weights, nd, F.col("doc_id"), best(4 * k), SCORED)
    named = top_of(part, "score", 4 * k).select("user_idx", "doc_id")
    full = named.join(weights, "doc_id").join(queries, ["user_idx", "term"]).groupBy("user_idx", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("s"))
    return top_of(full, "s", k).where(F.col("r") == k).select("user_idx", F.col("s").alias("edge"))


def top_of(scored: DataFrame, score: str, k: int, *by: str) -> DataFrame:
    """The k best documents of each user, and of what else they go by, with their place `r`."""
    return scored.withColumn("r", F.row_number().over(W.partitionBy("user_idx", *by).orderBy(F.desc(score), "doc_id"))).where(F.col("r") <= k)


def search_pruned(queries: DataFrame, weights: DataFrame, k: int = 10, span: int = 64, seeds: int = 10) -> DataFrame:
    """The same as `search`, rank for rank, without the scores of documents in spans that can't reach the k best.

    The bound of a span is the sum over the query's terms of weight x the largest document weight there. A span is passed
    over if that is under what k documents are sure to reach. Bounds, like scores, are summed up in arrays where a block of
    queries, which know their `edge`, meets a block of whole spans.
    """
    queries, weights = cut(queries, "queries"), cut(weights.select("doc_id", "term", "w"), "weights")
    nq, nd = parts(queries, QUERY_ROWS), parts(weights, POSTINGS)
    asked = queries.join(sure_scores(queries, weights, nq, nd, k, seeds), "user_idx", "left")
    return ranked(met(asked, nq, weights, nd, F.floor(F.col("doc_id") / span), best_pruned(k, span, 9), SCORED), k)


def span_work(queries: DataFrame, weights: DataFrame, k: int, span: int, seeds: int = 10, sets: tuple[str, ...] = ("q",), ends: tuple[float, ...] = (float("inf"),)) -> DataFrame:
    """(user_idx, v, touched, opened, spans, open_spans), some rows a query: its postings, those in spans that may hold one of its k best, and the spans.

    `sets` are columns of weights, null where a set lacks the term, and `ends` narrow the documents to ids up to each; `v` is the
    place of a set x the number of ends + that of an end. Bounds and edges are those of `search_pruned`. Blocks meet twice,
    for the edges and for the bounds, whatever the sets and ends. `queries` and `weights` are counted and read several times, so they should be tables.
    """
    nq, lists = parts(queries, QUERY_ROWS), packed(weights, F.floor(F.col("doc_id") / span), parts(weights, 2 * POSTINGS), "d", "term")
    blocks = lambda rows: packed(rows, F.col("user_idx"), nq, "q", "user_idx")
    tops = weights.groupBy("term").agg(*(F.max(F.when(F.col("doc_id") <= F.lit(end), F.col("w"))).alias(f"top{e}") for e, end in enumerate(ends)))
    named = paired(blocks(queries.join(tops, "term")), lists, sure(k, seeds, sets, ends), "user_idx bigint, v bigint, doc_id bigint, s double, full double")
    kth = top_of(top_of(named, "s", 4 * k, "v").drop("r"), "full", k, "v").where(F.col("r") == k)
    edges = kth.groupBy("user_idx").agg(*(F.max(F.when(F.col("v") == v, F.col("full"))).alias(f"e{v}") for v in range(len(sets) * len(ends))))
    return paired(blocks(queries.join(edges, "user_idx", "left")), lists, span_sums(span, sets, ends), "user_idx bigint, v bigint, touched bigint, opened bigint, spans bigint, open_spans bigint")


def score_pairs(pairs: DataFrame, queries: DataFrame, weights: DataFrame) -> DataFrame:
    """(user_idx, doc_id, score) of given pairs only, 0 where no term is shared: the work follows the pairs, not the corpus.

    The terms of the pairs are many times the queries, so the queries' part is hashed and the terms are never sorted.
    """
    pairs = pairs.select("user_idx", "doc_id").distinct()
    met = pairs.join(weights, "doc_id").join(queries.hint("shuffle_hash"), ["user_idx", "term"]).groupBy("user_idx", "doc_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    return pairs.join(met, ["user_idx", "doc_id"], "left").select("user_idx", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def explain(pairs: DataFrame, queries: DataFrame, weights: DataFrame, n: int = 5) -> DataFrame:
    """(user_idx, doc_id, term, part, rank): the n terms that add most to a pair's score."""
    parts = pairs.select("user_idx", "doc_id").distinct().join(weights, "doc_id").join(queries, ["user_idx", "term"]).select("user_idx", "doc_id", "term", F.round(F.col("q") * F.col("w"), 6).alias("part"))
    return parts.withColumn("rank", F.row_number().over(W.partitionBy("user_idx", "doc_id").orderBy(F.desc("part"), "term"))).where(F.col("rank") <= n)


# queries: articles by title and abstract


def article_index(spark: SparkSession, folder: str, text: str = "concat_ws(' ', title, abstract)", stop: bool = True) -> Index:
    return Index(articles(spark, folder), "idx", F.expr(text), F.col("lang"), stop)


def _users(spark, folder):
    """The stated query set of searches: users whose id is divisible by 50."""
    return histories(spark, folder).where("user_idx % 50 = 0")


def tokenize_q(spark, folder):
    return tokens(articles(spark, folder), "idx", F.expr("concat_ws(' ', title, abstract)"), F.col("lang")).groupBy("term").agg(F.count("*").alias("n"))


def postings_q(spark, folder):
    i = article_index(spark, folder)
    return i.postings.join(i.lengths, "doc_id").select("doc_id", "term", "tf", "dl")


def df_idf_q(spark, folder):
    return article_index(spark, folder).vocabulary.withColumn("idf", F.round("idf", 9))


def bm25_weight_q(spark, folder):
    return article_index(spark, folder).weights().withColumn("w", F.round("w", 6))


def bm25l_q(spark, folder):
    return article_index(spark, folder).weights(delta=0.5).withColumn("w", F.round("w", 6))


def query_from_history_q(spark, folder):
    return history_queries(histories(spark, folder), article_index(spark, folder).postings).withColumn("q", F.col("q").cast("bigint"))


def decayed_query_q(spark, folder):
    return history_queries(histories(spark, folder), article_index(spark, folder).postings, last=20, halflife=5.0).withColumn("q", F.round("q", 6))


def query_saturation_q(spark, folder):
    q = history_queries(histories(spark, folder), article_index(spark, folder).postings)
    return q.select("user_idx", "term", F.round(saturated(F.col("q"), 2.0), 6).alias("q2"), F.round(saturated(F.col("q"), 0.0), 6).alias("q0"))


def bm25_search_q(spark, folder):
    i = article_index(spark, folder)
    return search(history_queries(_users(spark, folder), i.postings), i.weights()).withColumn("score", F.round("score", 4))


def score_pairs_q(spark, folder):
    """Every user on every article they were shown; rows without a user are no pairs."""
    i = article_index(spark, folder)
    shown = pair_table(impressions(spark, folder, "user_idx is not null")).select("user_idx", F.col("article_idx").alias("doc_id"))
    return score_pairs(shown, history_queries(histories(spark, folder), i.postings), i.weights()).withColumn("score", F.round("score", 5))


def explain_q(spark, folder):
    i = article_index(spark, folder)
    queries = history_queries(_users(spark, folder), i.postings)
    return explain(search(queries, i.weights(), 3), queries, i.weights())


#: Rows of a block of the grid, about.
GRID_QUERY_ROWS, GRID_POSTINGS = 150_000, 500_000
K1S, BS = (0.6, 0.9, 1.2, 1.5), (0.3, 0.5, 0.75, 0.9)


def grid_q(spark, folder):
    """Recall at 100 over a grid of k1 and b on the validation split, the best one marked, with its recall on test; queries are all impressions of both splits.

    A clicked article is found if under a hundred rank before it, so these are counted instead of ranking all. Recall is that
    of the clicked articles of an impression, averaged over impressions with a click.
    """
    i, points = article_index(spark, folder), [(k1, b) for k1 in K1S for b in BS]
    asked = impressions(spark, folder).where(F.col("time") >= at(VAL_FROM))
    clicked = cut(asked.select(F.col("src_row").alias("imp"), "user_idx", (F.col("time") >= at(TEST_FROM)).alias("test"), F.explode(F.array_distinct("clicked")).alias("doc_id")).where("doc_id is not null and user_idx is not null"), "clicked")
    queries = cut(history_queries(histories(spark, folder).join(clicked.select("user_idx").distinct(), "user_idx", "left_semi"), i.postings), "queries")
    rows = i.postings.join(i.lengths, "doc_id").join(i.vocabulary, "term").crossJoin(F.broadcast(i.corpus))
    rows = cut(rows.select("doc_id", "term", "tf", "idf", (F.col("dl") / F.greatest("avgdl", F.lit(1e-6))).alias("long")), "weights")
    part = lambda k1, b: F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("long"))) * F.col("idf")
    met_ = clicked.select("user_idx", "doc_id").distinct().join(rows, "doc_id").join(queries, ["user_idx", "term"])
    pairs = met_.groupBy("user_idx", "doc_id").agg(F.array(*(F.round(F.sum(F.col("q") * part(*p)), 9) for p in points)).alias("s"))
    blocks = queries.unionByName(pairs, allowMissingColumns=True)
    counts = [f"c{p}" for p in range(len(points))]
    before = met(blocks, parts(queries, GRID_QUERY_ROWS), rows, parts(rows, GRID_POSTINGS), F.col("doc_id"), ahead(points, 100), f"user_idx bigint, doc_id bigint, {', '.join(f'{c} bigint' for c in counts)}")
    hits = before.groupBy("user_idx", "doc_id").agg(*((F.sum(c) < 100).cast("double").alias(c) for c in counts))
    each = clicked.join(queries.select("user_idx").distinct(), "user_idx", "left_semi").join(hits, ["user_idx", "doc_id"], "left").groupBy("imp", "test").agg(*(F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in counts))
    each = each.select("test", F.inline(F.array(*(F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(c).alias("recall")) for (k1, b), c in zip(points, counts)))))
    got = each.groupBy("k1", "b").agg(F.round(F.avg(F.when(~F.col("test"), F.col("recall"))), 6).alias("recall_val"), F.round(F.avg(F.when(F.col("test"), F.col("recall"))), 6).alias("recall_test"))
    first = F.row_number().over(W.orderBy(F.desc_nulls_last("recall_val"), "k1", "b")) == 1  # a row a point
    return got.withColumn("best", first).select("k1", "b", "recall_val", "best", F.when(F.col("best"), F.col("recall_test")).alias("recall_test"))


def stem_vocab_q(spark, folder):
    """Each distinct token of Danish articles once, with its stem."""
    rows = tokens(articles(spark, folder).where("lower(lang) = 'da'"), "idx", F.expr("concat_ws(' ', title, abstract)"), F.col("lang"))
    return stems(rows)


def stemmed_postings_q(spark, folder):
    """Document frequency of every term when Danish words are stemmed."""
    docs = articles(spark, folder)
    return Index(docs, "idx", F.expr("concat_ws(' ', title, abstract)"), F.col("lang"), stem=True).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


SPAN = 4


def wand_q(spark, folder):
    """The ten best articles of the stated query set by bounds of spans of four ids, as few articles as these tables have."""
    i = article_index(spark, folder)
    return search_pruned(history_queries(_users(spark, folder), i.postings), i.weights(), 10, SPAN).withColumn("score", F.round("score", 4))


def wand_scale_q(spark, folder):
    """Postings that a full search of the stated query set reads, and those in the spans the bounds leave, over the first quarter,
    half and all of the ids: for the terms of the article read last, and for those of all that was read."""
    i = article_index(spark, folder)
    weights = cut(i.weights().select("doc_id", "term", "w"), "weights")
    queries = cut(history_queries(_users(spark, folder), i.postings, newest=1), "queries")
    top = weights.agg(F.max("doc_id")).first()[0] or 0
    names, shares = ("last read", "all read"), (0.25, 0.5, 1.0)
    got = span_work(queries, weights, 10, SPAN, sets=("q_newest", "q"), ends=tuple(share * top for share in shares))
    rows = [(F.col("v") == v, name, share) for v, (name, share) in enumerate((name, share) for name in names for share in shares)]
    sums = got.agg(*(F.sum(F.when(own, F.col(c))).alias(f"{c}{v}") for v, (own, _, _) in enumerate(rows) for c in ("touched", "opened", "spans", "open_spans")))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(name).alias("terms"), F.lit(share).alias("share"), *(F.col(f"{c}{v}").alias(c) for c in ("touched", "opened")), *(F.coalesce(f"{c}{v}", F.lit(0)).alias(c) for c in ("spans", "open_spans"))) for v, (_, name, share) in enumerate(rows)))))


def field_variants_q(spark, folder):
    every = None
    for name, text, stop in (("title", "title", True), ("title+abstract", "concat_ws(' ', title, abstract)", True), ("title x2 + abstract", "concat_ws(' ', title, title, abstract)", True), ("all, no stop words", "concat_ws(' ', title, abstract, body)", False)):
        i = article_index(spark, folder, text, stop)
        one = i.postings.agg(F.lit(name).alias("variant"), F.count("*").alias("postings"), F.sum("tf").alias("occurrences"), F.count_distinct("term").alias("terms"))
        every = one if every is None else every.unionByName(one)
    return every


QUERIES = {
    "tokenize": tokenize_q, "postings": postings_q, "df_idf": df_idf_q, "bm25_weight": bm25_weight_q, "bm25l": bm25l_q, "query_from_history": query_from_history_q, "decayed_query": decayed_query_q,
    "query_saturation": query_saturation_q, "bm25_search": bm25_search_q, "score_pairs": score_pairs_q, "explain": explain_q, "grid": grid_q, "field_variants": field_variants_q,
    "stem_vocab": stem_vocab_q, "stemmed_postings": stemmed_postings_q, "wand": wand_q, "wand_scale": wand_scale_q,
}


def _words(name: str, text: str, stop: bool = True) -> str:
    lists = {x: ", ".join(f"'{w}'" for w in STOPWORDS[x]) for x in STOPWORDS}
    rule = f"AND CASE WHEN lang = 'da' THEN term NOT IN ({lists['da']}) ELSE term NOT IN ({lists['en']}) END" if stop else ""
    return f"""{name}_raw AS (SELECT idx AS doc_id, coalesce(lower(lang), 'en') AS lang, unnest(string_split(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), ' ')) AS term FROM art),
{name} AS (SELECT doc_id, term FROM {name}_raw WHERE length(term) >= 2 AND NOT regexp_full_match(term, '[0-9]+') {rule})"""


_INDEX = f"""WITH {ARTICLES}, {_words('tok', "concat_ws(' ', title, abstract)")},
post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), dls AS (SELECT idx AS doc_id, (SELECT count(*) FROM tok WHERE tok.doc_id = art.idx) AS dl FROM art), cp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
voc AS (SELECT term, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post, cp GROUP BY 1)"""


def _weighted(name: str, k1: float = K1, b: float = B) -> str:
    return f"{name} AS (SELECT p.doc_id, p.term, tf, tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / greatest(avgdl, 1e-6))) * idf AS w FROM post p JOIN dls ON dls.doc_id = p.doc_id JOIN voc ON voc.term = p.term, cp)"


_QUERY = f", {HISTORY}, qq AS (SELECT user_idx, term, CAST(sum(tf) AS BIGINT) AS q FROM hist_clicks h JOIN post ON post.doc_id = h.article_idx GROUP BY 1, 2), q50 AS (SELECT * FROM qq WHERE user_idx % 50 = 0)"
_SEARCH = ", sco AS (SELECT user_idx, doc_id, round(sum(q * w), 9) AS score FROM q50 JOIN wt ON wt.term = q50.term GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, doc_id) AS rank FROM sco)"

ORACLES = {
    "tokenize": _INDEX + " SELECT term, count(*) AS n FROM tok GROUP BY 1",
    "postings": _INDEX + " SELECT post.doc_id, term, tf, dl FROM post JOIN dls ON dls.doc_id = post.doc_id",
    "df_idf": _INDEX + " SELECT term, df, round(idf, 9) AS idf FROM voc",
    "bm25_weight": _INDEX + ", " + _weighted("wt") + " SELECT doc_id, term, tf, round(w, 6) AS w FROM wt",
    "bm25l": _INDEX + f", c AS (SELECT p.doc_id, p.term, tf, idf, tf / (1 - {B} + {B} * dl / greatest(avgdl, 1e-6)) AS c FROM post p JOIN dls ON dls.doc_id = p.doc_id JOIN voc ON voc.term = p.term, cp) SELECT doc_id, term, tf, round(idf * ({K1} + 1) * (c + 0.5) / ({K1} + c + 0.5), 6) AS w FROM c",
    "query_from_history": _INDEX + _QUERY + " SELECT * FROM qq",
    "decayed_query": _INDEX + _QUERY + ", ag AS (SELECT *, max(i) OVER (PARTITION BY user_idx) - i AS age FROM hist_clicks) SELECT user_idx, term, round(sum(tf * pow(0.5, age / 5.0)), 6) AS q FROM ag JOIN post ON post.doc_id = ag.article_idx WHERE age < 20 GROUP BY 1, 2",
    "query_saturation": _INDEX + _QUERY + " SELECT user_idx, term, round(3.0 * q / (2 + q), 6) AS q2, CAST(1 AS DOUBLE) AS q0 FROM qq",
    "bm25_search": _INDEX + _QUERY + ", " + _weighted("wt") + _SEARCH + " SELECT user_idx, doc_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10",
    "score_pairs": _INDEX + _QUERY + ", " + _weighted("wt") + """, sh AS (SELECT DISTINCT user_idx, unnest(candidates) AS doc_id FROM impressions WHERE user_idx IS NOT NULL), ps AS (SELECT DISTINCT sh.user_idx, sh.doc_id FROM sh)
        SELECT ps.user_idx, ps.doc_id, round(coalesce(sum(q * w), 0), 5) AS score FROM ps LEFT JOIN wt ON wt.doc_id = ps.doc_id LEFT JOIN qq ON qq.user_idx = ps.user_idx AND qq.term = wt.term GROUP BY 1, 2""",
    "explain": _INDEX + _QUERY + ", " + _weighted("wt") + _SEARCH + """, pt AS (SELECT r.user_idx, r.doc_id, q50.term, round(q * w, 6) AS part FROM ranked r JOIN wt ON wt.doc_id = r.doc_id JOIN q50 ON q50.user_idx = r.user_idx AND q50.term = wt.term WHERE rank <= 3)
        SELECT user_idx, doc_id, term, part, CAST(row_number() OVER (PARTITION BY user_idx, doc_id ORDER BY part DESC, term) AS INT) AS rank FROM pt QUALIFY rank <= 5""",
    "grid": _INDEX + _QUERY + f""", {IMP}, g(k1) AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in K1S)}])), h(b) AS (SELECT unnest([{", ".join(f"{x}::DOUBLE" for x in BS)}])),
        ask AS (SELECT * FROM imp WHERE time >= TIMESTAMP '{VAL_FROM}'), qa AS (SELECT * FROM qq WHERE user_idx IN (SELECT user_idx FROM ask)),
        sc AS (SELECT k1, b, user_idx, p.doc_id, round(sum(q * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / greatest(avgdl, 1e-6))) * idf)), 9) AS s FROM qa JOIN post p ON p.term = qa.term JOIN dls ON dls.doc_id = p.doc_id JOIN voc ON voc.term = p.term, cp, g, h GROUP BY ALL),
        tp AS (SELECT k1, b, user_idx, doc_id FROM sc QUALIFY row_number() OVER (PARTITION BY k1, b, user_idx ORDER BY s DESC, doc_id) <= 100),
        cl AS (SELECT DISTINCT src_row, user_idx, time >= TIMESTAMP '{TEST_FROM}' AS test, unnest(clicked) AS a FROM ask WHERE user_idx IN (SELECT user_idx FROM qa)),
        e AS (SELECT g.k1, h.b, src_row, test, avg(CAST(tp.doc_id IS NOT NULL AS INT)) AS r FROM cl CROSS JOIN g CROSS JOIN h LEFT JOIN tp ON tp.k1 = g.k1 AND tp.b = h.b AND tp.user_idx = cl.user_idx AND tp.doc_id = cl.a WHERE a IS NOT NULL GROUP BY ALL),
        t AS (SELECT k1, b, round(avg(r) FILTER (NOT test), 6) AS recall_val, round(avg(r) FILTER (test), 6) AS recall_test FROM e GROUP BY 1, 2), f AS (SELECT *, row_number() OVER (ORDER BY recall_val DESC NULLS LAST, k1, b) = 1 AS best FROM t)
        SELECT k1, b, recall_val, best, CASE WHEN best THEN recall_test END AS recall_test FROM f""",
    "stem_vocab": f"WITH {ARTICLES}, {_words('tok', "concat_ws(' ', title, abstract)")}, d AS (SELECT DISTINCT term FROM tok JOIN art ON idx = doc_id WHERE lower(lang) = 'da') SELECT term, {danish_sql('term')} AS stem FROM d",
    "stemmed_postings": f"""WITH {ARTICLES}, {_words('tok', "concat_ws(' ', title, abstract)")}, d AS (SELECT DISTINCT term FROM tok JOIN art ON idx = doc_id WHERE lower(lang) = 'da'), st AS (SELECT term, {danish_sql('term')} AS stem FROM d),
        s AS (SELECT doc_id, CASE WHEN lower(lang) = 'da' THEN stem ELSE tok.term END AS term FROM tok JOIN art ON idx = doc_id LEFT JOIN st ON st.term = tok.term) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM s GROUP BY 1""",
    "wand": _INDEX + _QUERY + ", " + _weighted("wt") + _SEARCH + " SELECT user_idx, doc_id, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 10",
    "field_variants": f"WITH {ARTICLES}, {_words('t1', 'title')}, " + ", ".join(_words(n, t, s) for n, t, s in (("t2", "concat_ws(' ', title, abstract)", True), ("t3", "concat_ws(' ', title, title, abstract)", True), ("t4", "concat_ws(' ', title, abstract, body)", False)))
    + " " + " UNION ALL ".join(f"SELECT '{v}' AS variant, count(DISTINCT (doc_id, term)) AS postings, count(*) AS occurrences, count(DISTINCT term) AS terms FROM {n}" for n, v in (("t1", "title"), ("t2", "title+abstract"), ("t3", "title x2 + abstract"), ("t4", "all, no stop words"))),
}
