"""Inverted lists as a table: transposed postings, gaps, code sizes, work counters, caching and tiering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.blocks import POSTINGS, QUERY_ROWS, met, parts, scored
from clicklake.operators.lexical import article_index, history_queries, tokens
from clicklake.sources.logs import ARTICLES, HISTORY, articles, clicks, histories, impressions
from clicklake.operators.lexical import _words as words_sql
from clicklake.plans.cut import cut

SPAN = 1 << 16
BLOCK = 128


def transposed(postings: DataFrame) -> DataFrame:
    """(term, span, docs, df, max_tf): sorted document ids of a term per span of 65,536 ids, so that no list outgrows a row."""
    span = F.floor(F.col("doc_id") / SPAN)
    return postings.groupBy("term", span.alias("span")).agg(F.array_sort(F.collect_list("doc_id")).alias("docs"), F.count("*").alias("df"), F.max("tf").alias("max_tf"))


def gaps(postings: DataFrame) -> DataFrame:
    """(term, doc_id, gap): the id itself for a term's first document, then differences; spans are joined by their last ids."""
    rows = postings.select("term", "doc_id", F.floor(F.col("doc_id") / SPAN).alias("span"))
    ends = rows.groupBy("term", "span").agg(F.max("doc_id").alias("last"))
    ends = ends.select("term", "span", F.lag("last").over(W.partitionBy("term").orderBy("span")).alias("carry"))
    inside = rows.withColumn("before", F.lag("doc_id").over(W.partitionBy("term", "span").orderBy("doc_id")))
    return inside.join(ends, ["term", "span"]).select("term", "doc_id", (F.col("doc_id") - F.coalesce("before", "carry", F.lit(0))).alias("gap"))


def bit_length(x: Column) -> Column:
    """Bits of a positive number."""
    return F.length(F.bin(x))


def code_sizes(postings: DataFrame) -> DataFrame:
    """(term, df, vbyte, gamma_bits, packed_bits, roaring): sizes of a term's list under four codes.

    Gaps of 0 (document 0 first) cost as 1 in gamma. Packing takes blocks of 128 gaps within a span at the width of the
    largest; Roaring takes 2 bytes an id up to 4,096 of a span, else 8,192 bytes, and 8 bytes a term.
    """
    g = gaps(postings).withColumn("span", F.floor(F.col("doc_id") / SPAN))
    block = F.floor((F.row_number().over(W.partitionBy("term", "span").orderBy("doc_id")) - 1) / BLOCK)
    one = F.greatest("gap", F.lit(1))
    per = g.withColumn("block", block).groupBy("term", "span", "block").agg(F.count("*").alias("n"), F.sum(F.ceil(bit_length(one) / 7)).alias("vbyte"), F.sum(2 * bit_length(one) - 1).alias("gamma"), F.max(bit_length(one)).alias("width"))
    per = per.groupBy("term", "span").agg(F.sum("n").alias("n"), F.sum("vbyte").alias("vbyte"), F.sum("gamma").alias("gamma"), F.sum(F.col("width") * BLOCK).alias("packed"))
    roaring = F.sum(F.when(F.col("n") > 4096, 8192).otherwise(2 * F.col("n"))) + 8
    return per.groupBy("term").agg(F.sum("n").alias("df"), F.sum("vbyte").alias("vbyte"), F.sum("gamma").alias("gamma_bits"), F.sum("packed").alias("packed_bits"), roaring.alias("roaring"))


def traversal_work(queries: DataFrame, postings: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(user_idx, terms, touched, scored): what a full traversal of each query's lists reads and how many documents it scores.

    Spark evaluates one plan for every traversal order; term- and document-at-a-time touch the same postings. Documents are
    marked where a block of queries meets a block of documents; a block's number of them is all that leaves it.
    """
    queries = cut(queries.select("user_idx", "term", "q"), "queries")
    touched = queries.join(vocabulary, "term").groupBy("user_idx").agg(F.count("*").alias("terms"), F.sum("df").alias("touched"))
    marked = met(queries, parts(queries, QUERY_ROWS), postings.select("doc_id", "term"), parts(postings, POSTINGS), F.col("doc_id"), scored, "user_idx bigint, n bigint")
    return touched.join(marked.groupBy("user_idx").agg(F.sum("n").alias("scored")), "user_idx")


def skip_steps(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(common, plain, skipping): what two sorted lists share, and the steps of a merge without and with skips of about the root of their length."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    if not len(a) or not len(b):
        return both, 0, 0
    # a plain merge steps once a posting until either list ends
    end = min(a[-1], b[-1])
    plain = int((a <= end).sum() + (b <= end).sum()) - both
    steps = 0
    i = j = 0
    skip_a, skip_b = max(1, int(len(a) ** 0.5)), max(1, int(len(b) ** 0.5))
    while i < len(a) and j < len(b):
        steps += 1
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += skip_a if i % skip_a == 0 and i + skip_a < len(a) and a[i + skip_a] <= b[j] else 1
        else:
            j += skip_b if j % skip_b == 0 and j + skip_b < len(b) and b[j + skip_b] <= a[i] else 1
    return both, plain, steps


def conjunction(two: DataFrame, lists: DataFrame) -> DataFrame:
    """(user_idx, docs, plain, skipping): documents that hold both of a user's terms, and the steps to find them.

    `two` has (user_idx, term, df), two rows a user; `lists` has (term, span, docs). The lists of a pair of terms meet span by
    span, so no list is longer than a span.
    """
    order = F.row_number().over(W.partitionBy("user_idx").orderBy("df", "term"))
    pair = two.withColumn("r", order).groupBy("user_idx").agg(F.max(F.when(F.col("r") == 1, F.col("term"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("term"))).alias("second")).where("second is not null")
    x, y = lists.select(F.col("term").alias("first"), "span", F.col("docs").alias("x")), lists.select(F.col("term").alias("second"), "span", F.col("docs").alias("y"))
    met = pair.join(x, "first").join(y, ["second", "span"]).select("user_idx", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([skip_steps(b.column(1)[i].values.to_numpy(), b.column(2)[i].values.to_numpy()) for i in range(b.num_rows)], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in got.T)], ["user_idx", "docs", "plain", "skipping"])

    return met.mapInArrow(run, "user_idx bigint, docs bigint, plain bigint, skipping bigint").groupBy("user_idx").agg(*(F.sum(c).alias(c) for c in ("docs", "plain", "skipping")))


def static_cache(requests: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """One row: lists held, bytes, and the share of requests served when lists enter by number of requests until the budget is full.

    Lists with the same number of requests enter together or not at all, so the running sum is over distinct numbers.
    """
    rows = requests.join(sizes, "term").groupBy("requests").agg(F.count("*").alias("lists"), F.sum("bytes").alias("bytes"))
    rows = rows.withColumn("filled", F.sum("bytes").over(W.orderBy(F.desc("requests"))))
    held = F.col("filled") <= budget
    served = F.col("requests") * F.col("lists")
    return rows.agg(F.sum(F.when(held, F.col("lists")).otherwise(0)).alias("lists"), F.sum(F.when(held, F.col("bytes")).otherwise(0)).alias("bytes"), (F.sum(F.when(held, served).otherwise(0)) / F.sum(served)).alias("hit_rate"))


def tiering(click: DataFrame, article: DataFrame, shares: tuple[float, ...] = (0.05, 0.2, 0.5)) -> DataFrame:
    """(share, articles, mass): the clicks that fall on articles at or above the clicks quantile that leaves that share on top."""
    counts = article.select(F.col("idx").alias("article_idx")).join(click.groupBy("article_idx").agg(F.count("*").alias("n")), "article_idx", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("articles"))
    cuts = counts.agg(*(F.percentile("n", F.lit(1 - s)).alias(f"c{i}") for i, s in enumerate(shares)))
    met = levels.crossJoin(F.broadcast(cuts)).select("n", "articles", F.inline(F.array(*(F.struct(F.lit(s).alias("share"), F.col(f"c{i}").alias("cut")) for i, s in enumerate(shares)))))
    over = F.col("n") >= F.col("cut")
    return met.groupBy("share").agg(F.sum(F.when(over, F.col("articles")).otherwise(0)).alias("articles"), (F.sum(F.when(over, F.col("n") * F.col("articles")).otherwise(0)) / F.sum(F.col("n") * F.col("articles"))).alias("mass"))


# queries


def _users(spark, folder):
    """The stated query set of searches: users whose id is divisible by 50."""
    return histories(spark, folder).where("user_idx % 50 = 0")


def postings_transpose_q(spark, folder):
    got = transposed(article_index(spark, folder).postings)
    return got.select("term", "span", F.array_join(F.col("docs").cast("array<string>"), ",").alias("docs"), "df", "max_tf")


def d_gaps_q(spark, folder):
    return gaps(article_index(spark, folder).postings)


def code_sizes_q(spark, folder):
    return code_sizes(article_index(spark, folder).postings)


def traversal_work_q(spark, folder):
    i = article_index(spark, folder)
    return traversal_work(history_queries(_users(spark, folder), i.postings), i.postings, i.vocabulary)


def conj_order_q(spark, folder):
    """Documents that hold both of a user's two rarest query terms, the rarer list first, for the users of whom there are any."""
    return _conjunction(spark, folder).where("docs > 0").select("user_idx", "docs")


def skip_list_q(spark, folder):
    """The steps of those intersections, merged plainly and with skips."""
    return _conjunction(spark, folder)


def _conjunction(spark, folder):
    i = article_index(spark, folder)
    q = history_queries(histories(spark, folder), i.postings).join(i.vocabulary, "term")
    two = q.withColumn("r", F.row_number().over(W.partitionBy("user_idx").orderBy("df", "term"))).where("r <= 2").select("user_idx", "term", "df")
    return conjunction(two, transposed(i.postings))


def static_cache_q(spark, folder):
    i = article_index(spark, folder)
    requests = history_queries(histories(spark, folder), i.postings).groupBy("term").agg(F.count("*").alias("requests"))
    return static_cache(requests, i.vocabulary.select("term", (F.col("df") * 8).alias("bytes")), 16_000).withColumn("hit_rate", F.round("hit_rate", 6))


def tiering_q(spark, folder):
    return tiering(clicks(impressions(spark, folder)), articles(spark, folder)).withColumn("mass", F.round("mass", 6))


def spimi_q(spark, folder):
    """Postings of blocks of documents, built apart and merged: the same as those built at once."""
    text, every = F.expr("concat_ws(' ', title, abstract)"), None
    for block in range(4):
        own = tokens(articles(spark, folder).where(F.col("idx") % 4 == block), "idx", text, F.col("lang")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
        every = own if every is None else every.unionByName(own)
    return every.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.min("doc_id").alias("first"))


QUERIES = {
    "postings_transpose": postings_transpose_q, "d_gaps": d_gaps_q, "code_sizes": code_sizes_q, "traversal_work": traversal_work_q, "conj_order": conj_order_q, "skip_list": skip_list_q, "static_cache": static_cache_q, "tiering": tiering_q, "spimi": spimi_q,
}

_P = f"WITH {ARTICLES}, " + words_sql("tok", "concat_ws(' ', title, abstract)") + ", post AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), voc AS (SELECT term, count(*) AS df FROM post GROUP BY 1)"
_Q = f", {HISTORY}, qq AS (SELECT DISTINCT user_idx, term FROM hist_clicks h JOIN post ON post.doc_id = h.article_idx), q50 AS (SELECT * FROM qq WHERE user_idx % 50 = 0)"
_G = ", gp AS (SELECT term, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post)"

ORACLES = {
    "postings_transpose": _P + " SELECT term, doc_id // 65536 AS span, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS docs, count(*) AS df, max(tf) AS max_tf FROM post GROUP BY 1, 2",
    "d_gaps": _P + _G + " SELECT term, doc_id, gap FROM gp",
    "code_sizes": _P + _G + """, b AS (SELECT *, doc_id // 65536 AS span, floor(log2(greatest(gap, 1))) + 1 AS bits, (row_number() OVER (PARTITION BY term, doc_id // 65536 ORDER BY doc_id) - 1) // 128 AS block FROM gp),
        pb AS (SELECT term, span, block, max(bits) * 128 AS packed FROM b GROUP BY 1, 2, 3), pk AS (SELECT term, sum(packed) AS packed FROM pb GROUP BY 1), ro AS (SELECT term, sum(CASE WHEN n > 4096 THEN 8192 ELSE 2 * n END) + 8 AS roaring FROM (SELECT term, span, count(*) AS n FROM b GROUP BY 1, 2) GROUP BY 1)
        SELECT b.term, count(*) AS df, CAST(sum(ceil(bits / 7)) AS BIGINT) AS vbyte, CAST(sum(2 * bits - 1) AS BIGINT) AS gamma_bits, CAST(any_value(packed) AS BIGINT) AS packed_bits, CAST(any_value(roaring) AS BIGINT) AS roaring FROM b JOIN pk ON pk.term = b.term JOIN ro ON ro.term = b.term GROUP BY 1""",
    "traversal_work": _P + _Q + " SELECT q50.user_idx, count(DISTINCT q50.term) AS terms, count(*) AS touched, count(DISTINCT doc_id) AS scored FROM q50 JOIN post ON post.term = q50.term GROUP BY 1",
    "conj_order": _P + _Q + ", tw AS (SELECT user_idx, qq.term FROM qq JOIN voc ON voc.term = qq.term QUALIFY row_number() OVER (PARTITION BY user_idx ORDER BY df, qq.term) <= 2) SELECT user_idx, count(*) AS docs FROM (SELECT user_idx, doc_id FROM tw JOIN post ON post.term = tw.term GROUP BY 1, 2 HAVING count(*) = 2) GROUP BY 1",
    "static_cache": _P + _Q + ", rq AS (SELECT term, count(*) AS requests FROM qq GROUP BY 1), lv AS (SELECT requests, count(*) AS lists, sum(df * 8) AS bytes FROM rq JOIN voc ON voc.term = rq.term GROUP BY 1), f AS (SELECT *, sum(bytes) OVER (ORDER BY requests DESC) <= 16000 AS held FROM lv) SELECT CAST(coalesce(sum(lists) FILTER (held), 0) AS BIGINT) AS lists, CAST(coalesce(sum(bytes) FILTER (held), 0) AS BIGINT) AS bytes, round(coalesce(sum(requests * lists) FILTER (held), 0) / sum(requests * lists), 6) AS hit_rate FROM f",
    "tiering": f"""WITH {ARTICLES}, imp AS (SELECT DISTINCT ON (src_row) * FROM impressions), rc AS (SELECT user_idx, unnest(clicked) AS article_idx, time AS ts FROM imp), cl AS (SELECT DISTINCT * FROM rc WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND ts IS NOT NULL),
        n AS (SELECT idx, count(cl.article_idx) AS n FROM art LEFT JOIN cl ON cl.article_idx = idx GROUP BY 1), s(share) AS (VALUES (CAST(0.05 AS DOUBLE)), (0.2), (0.5)), c AS (SELECT share, (SELECT quantile_cont(n, 1 - 0.05) FROM n) AS c1, (SELECT quantile_cont(n, 1 - 0.2) FROM n) AS c2, (SELECT quantile_cont(n, 1 - 0.5) FROM n) AS c3 FROM s)
        SELECT share, count(*) FILTER (n >= CASE share WHEN 0.05 THEN c1 WHEN 0.2 THEN c2 ELSE c3 END) AS articles, round(coalesce(sum(n) FILTER (n >= CASE share WHEN 0.05 THEN c1 WHEN 0.2 THEN c2 ELSE c3 END), 0) / sum(n), 6) AS mass FROM c, n GROUP BY 1""",
    "spimi": _P + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(doc_id) AS first FROM post GROUP BY 1",
}
