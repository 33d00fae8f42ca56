"""Exact and near copies by shingles, sketches of sets and streams, and the shape of a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.operators.candidates import _BEST, rrf
from clicklake.plans.cut import cut
from clicklake.plans.graph import components
from clicklake.sources.logs import CUTOFF, IMP, at, clicks, impressions
from clicklake.sources.tables import table

P = 2_147_483_647
WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 16, 4


def normal(text: Column) -> Column:
    """Lower case, each run of blanks and line ends one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "[ \t\r\n]+", " "))


def shingles(text: Column, words: int = WORDS) -> Column:
    """The distinct runs of so many words of a normalised text; none for a shorter text.

    The split text is the variable of an outer lambda: inside the inner one its expression would be evaluated at every step.
    """
    none = F.array().cast("array<string>")
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - words + 1), lambda i: F.array_join(F.slice(w, i, words), " "))
    return F.array_distinct(F.transform(F.array(F.split(text, " ")), lambda w: F.when(F.size(w) >= words, runs(w)).otherwise(none))[0])


def distinct_texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text): each distinct normalised text under its smallest id; null and blank texts are left out."""
    rows = docs.select(F.col(doc_id).alias("id"), normal(F.col(text)).alias("text")).where("id is not null and text <> ''").withColumn("digest", F.sha2("text", 256))
    least = rows.groupBy("digest").agg(F.min("id").alias("id")).select("id")
    return rows.join(least, "id", "left_semi").dropDuplicates(["id"]).select("id", "text")


def similar_texts(docs: DataFrame, doc_id: str, text: str, threshold: float = SIMILAR, words: int = WORDS) -> DataFrame:
    """(a, b, jaccard), a < b: all pairs of distinct texts whose sets of shingles are as similar as the threshold.

    Exact, by prefix filtering: shingles are put in order of rarity; sets of Jaccard t share one of the first
    n - ceil(t n) + 1 of each. Only those prefixes are joined, sizes must fit, and the candidates' full sets are intersected.
    """
    sets = distinct_texts(docs, doc_id, text).select("id", F.transform(shingles(F.col("text"), words), lambda s: F.xxhash64(s)).alias("set")).where("size(set) > 0")
    sets = cut(sets.withColumn("n", F.size("set")), "sets")
    opened = sets.select("id", "n", F.explode("set").alias("s"))
    df = opened.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    w = W.partitionBy("id").orderBy("rare", "s")
    ordered = opened.join(df, "s", "left").select("id", "n", "s", F.coalesce("df", F.lit(1)).alias("rare"))
    prefix = ordered.withColumn("r", F.row_number().over(w)).where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("rare") > 1)).select("id", "n", "s")
    x, y = prefix.toDF("a", "n_a", "s"), prefix.toDF("b", "n_b", "s")
    pairs = x.join(y, "s").where("a < b").where((F.col("n_a") >= threshold * F.col("n_b")) & (F.col("n_b") >= threshold * F.col("n_a"))).select("a", "b").distinct()
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.select("a", "b", (both / (F.size("x") + F.size("y") - both)).alias("jaccard")).where(F.col("jaccard") >= threshold - 1e-9)


def text_hash(s: Column) -> Column:
    """28 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("bigint")


def seeds(n: int) -> list[tuple[int, int]]:
    """Multipliers and shifts of the hash family (a h + b) mod 2^31 - 1."""
    return [((1_103_515_245 * (i + 1) + 12_345) % (P - 1) + 1, (69_069 * (i + 1) + 1) % P) for i in range(n)]


def min_hashes(hashes: Column, n: int = BANDS * ROWS) -> Column:
    """The least value of a set under each of n hash functions; null for an empty set. No shuffle: the set lies in the row."""
    least = lambda a, b: F.array_min(F.transform(hashes, lambda h: (h * a + b) % P))
    return F.when(F.size(hashes) > 0, F.array(*(least(a, b) for a, b in seeds(n))))


def halves(s: Column) -> Column:
    """64 bits of MD5 as two numbers of 32 bits, the same in any engine."""
    digest = F.md5(s)
    return F.struct(*(F.conv(F.substring(digest, i, 8), 16, 10).cast("bigint").alias(c) for i, c in ((1, "hi"), (9, "lo"))))


def sim_hash(hashes: Column, bits: int = 32) -> Column:
    """Bit i is set if it is in more than half of the hashes."""
    votes = lambda i: F.aggregate(hashes, F.lit(0), lambda a, h: a + F.when(F.shiftright(h, i).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1))
    return sum((F.when(votes(i) > 0, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(bits)), F.lit(0)).cast("bigint")


def sim_hashes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, hi, lo): the 64-bit sim-hash of each distinct text with shingles, as halves of 32 bits; votes are counted in Arrow batches."""
    rows = distinct_texts(docs, doc_id, text).select("id", F.transform(shingles(F.col("text")), halves).alias("h")).where("size(h) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            out = []
            for name in ("hi", "lo"):
                x = flat.field(name).to_numpy().astype(np.uint32)
                votes = np.column_stack([np.add.reduceat(((x >> np.uint32(i)) & np.uint32(1)).astype(np.int64), ends[:-1]) for i in range(32)]) if b.num_rows else np.zeros((0, 32), np.int64)
                most = 2 * votes > np.diff(ends)[:, None]
                out.append(pa.array((most.astype(np.int64) << np.arange(32)).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *out], ["id", "hi", "lo"])

    return rows.mapInArrow(run, "id bigint, hi bigint, lo bigint")


def sketched(spark: SparkSession, folder: str) -> DataFrame:
    rows = distinct_texts(table(spark, folder, "documents"), "doc_id", "text")
    return rows.select("id", F.transform(shingles(F.col("text")), text_hash).alias("h"))


def bands(sketches: DataFrame) -> DataFrame:
    """(id, band, bucket) of min-hash sketches `m`: the values of a band, joined, are its bucket."""
    parts = F.array(*(F.concat_ws("-", *(F.col("m")[i * ROWS + j].cast("string") for j in range(ROWS))) for i in range(BANDS)))
    return sketches.where("m is not null").select("id", F.posexplode(parts).alias("band", "bucket"))


def count_min(items: DataFrame, key: str, depth: int = 5, width: int = 1024) -> DataFrame:
    """(row, cell, n): the counters of a count-min sketch, depth x width rows at most."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("row"), ((F.col(key) * a + b) % P % width).alias("cell")) for i, (a, b) in enumerate(seeds(depth)))))
    return items.where(f"{key} is not null").select(cells.alias("c")).groupBy("c.row", "c.cell").agg(F.count("*").alias("n"))


def count_min_estimates(keys: DataFrame, key: str, sketch: DataFrame, depth: int = 5, width: int = 1024) -> DataFrame:
    """(key, estimate): the least of a key's counters."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("row"), ((F.col(key) * a + b) % P % width).alias("cell")) for i, (a, b) in enumerate(seeds(depth)))))
    return keys.select(key, cells.alias("c")).select(key, "c.row", "c.cell").join(F.broadcast(sketch), ["row", "cell"]).groupBy(key).agg(F.min("n").alias("estimate"))


def bloom_bits(items: DataFrame, owner: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """(owner, m, bit): the set bits of one Bloom filter an owner, m = bits x keys wide, round(bits ln 2) hashes a key."""
    k = max(1, round(bits_per_key * 0.6931))
    sized = items.groupBy(owner).agg((F.count_distinct(key) * bits_per_key).alias("m"))
    return items.select(owner, key).distinct().join(sized, owner).select(owner, "m", F.explode(_positions(F.col(key), F.col("m"), k)).alias("bit")).distinct()


def _positions(key: Column, m: Column, k: int) -> Column:
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(P)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(P))
    return F.array(*((h1 + i * h2) % m for i in range(k)))


# queries


def exact_dedup_q(spark, folder):
    rows = table(spark, folder, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    return rows.where("docs > 1")


def shingles_q(spark, folder):
    rows = distinct_texts(table(spark, folder, "documents"), "doc_id", "text")
    return rows.select("id", F.size(shingles(F.col("text"))).alias("n"))


def exact_jaccard_q(spark, folder):
    return similar_texts(table(spark, folder, "documents"), "doc_id", "text").withColumn("jaccard", F.round("jaccard", 6))


def minhash_q(spark, folder):
    return sketched(spark, folder).select("id", min_hashes(F.col("h"), 8).alias("m")).where("m is not null").select("id", *(F.col("m")[i].alias(f"m{i}") for i in range(8)))


def lsh_banding_q(spark, folder):
    """Buckets of more than one text; no pairs are spelled out."""
    got = bands(sketched(spark, folder).select("id", min_hashes(F.col("h")).alias("m")))
    return got.groupBy("band", "bucket").agg(F.count("*").alias("docs"), F.min("id").alias("least")).where("docs > 1")


def lsh_verify_q(spark, folder):
    """Of the truly similar pairs by similarity, how many share a bucket of any band."""
    pairs = similar_texts(table(spark, folder, "documents"), "doc_id", "text")
    sketches = cut(sketched(spark, folder).select("id", min_hashes(F.col("h")).alias("m")), "sketches")
    met = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")
    same = F.array(*(F.slice("x", i * ROWS + 1, ROWS) == F.slice("y", i * ROWS + 1, ROWS) for i in range(BANDS)))
    return met.groupBy(F.least(F.floor(F.col("jaccard") * 20) / 20, F.lit(0.95)).alias("bin")).agg(F.count("*").alias("pairs"), F.count_if(F.array_contains(same, True)).alias("found"))


def simhash_q(spark, folder):
    """The 64-bit sim-hash of every text, in hexadecimal."""
    return sim_hashes(table(spark, folder, "documents"), "doc_id", "text").select("id", F.lower(F.format_string("%08x%08x", "hi", "lo")).alias("simhash"))


def hamming_q(spark, folder):
    """Distance of the 64-bit sim-hashes of truly similar texts."""
    pairs = similar_texts(table(spark, folder, "documents"), "doc_id", "text")
    hashes = cut(sim_hashes(table(spark, folder, "documents"), "doc_id", "text"), "simhash")
    met = pairs.join(hashes.toDF("a", "h1", "l1"), "a").join(hashes.toDF("b", "h2", "l2"), "b")
    return met.select("a", "b", (F.bit_count(F.col("h1").bitwiseXOR(F.col("h2"))) + F.bit_count(F.col("l1").bitwiseXOR(F.col("l2")))).alias("distance"))


def _article_clicks(spark, folder):
    """(article_idx, clicks) of the labelled impressions."""
    return clicks(impressions(spark, folder)).groupBy("article_idx").agg(F.count("*").alias("clicks"))


def canonical_texts(pairs: DataFrame, popularity: DataFrame) -> DataFrame:
    """(id, canonical): each text of a group of similar ones (pairs a, b) with the group's most clicked member (id, clicks), the smallest id of equal ones."""
    groups = cut(components(pairs), "groups")
    known = groups.join(popularity.withColumnRenamed("id", "node"), "node", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0)))
    best = known.groupBy("label").agg(F.min(F.struct((-F.col("clicks")).alias("c"), "node"))["node"].alias("canonical"))
    return groups.join(best, "label").select(F.col("node").alias("id"), "canonical")


def _text_groups(spark, folder) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents")
    pairs = cut(similar_texts(docs, "doc_id", "text"), "similar")
    own = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("article_idx").alias("article_idx"))
    return pairs, canonical_texts(pairs, own.join(_article_clicks(spark, folder), "article_idx").select("id", "clicks"))


def dup_clusters_q(spark, folder):
    """Distinct texts of one group of similar ones, with the group's most clicked member and each text's number of links."""
    pairs, groups = _text_groups(spark, folder)
    links = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).groupBy("id").agg(F.count("*").alias("links"))
    return groups.join(links, "id").select("id", "canonical", "links")


def recall_canonical_q(spark, folder):
    """Recall of ten fused articles on the test split as shown, and with each article under that of its text group's canonical member."""
    _, groups = _text_groups(spark, folder)
    docs = table(spark, folder, "documents").where("article_idx is not null").groupBy("doc_id").agg(F.min("article_idx").alias("article_idx"))
    own = groups.join(docs.withColumnRenamed("doc_id", "id"), "id").join(docs.toDF("canonical", "to"), "canonical")
    to = cut(own.groupBy("article_idx").agg(F.min("to").alias("to")), "canonical")
    lists, imp = rrf(table(spark, folder, "topk_scores"), "retriever", 10), impressions(spark, folder, F.col("time") >= at(CUTOFF))
    clicked = imp.where("user_idx is not null").select(F.col("src_row").alias("imp"), "user_idx", F.explode(F.array_distinct("clicked")).alias("article_idx")).where("article_idx is not null")
    under = lambda df: df.join(to, "article_idx", "left").withColumn("article_idx", F.coalesce("to", "article_idx")).drop("to").distinct()
    every = None
    for name, c, l in (("as they are", clicked, lists.select("user_idx", "article_idx")), ("canonical", under(clicked), under(lists.select("user_idx", "article_idx")))):
        each = c.join(l.withColumn("hit", F.lit(1.0)), ["user_idx", "article_idx"], "left").groupBy("imp").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
        one = each.agg(F.lit(name).alias("ids"), F.count("*").alias("impressions"), F.round(F.avg("recall"), 6).alias("recall"))
        every = one if every is None else every.unionByName(one)
    return every


def _words(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.split(normal(F.col("text")), " ")).alias("word")).where("word <> ''")


def zipf_q(spark, folder):
    """Slope of log frequency on log rank over the distinct frequencies, and the share of words that occur once."""
    counts = _words(spark, folder).groupBy("word").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("words"))
    ranked = counts.withColumn("rank", F.sum("words").over(W.orderBy(F.desc("n"))))  # one row a distinct frequency
    return ranked.agg(F.round(F.regr_slope(F.log10("n"), F.log10("rank")), 6).alias("slope"), F.round(F.sum(F.when(F.col("n") == 1, F.col("words"))) / F.sum("words"), 6).alias("hapax_share"), F.sum("words").alias("vocabulary"))


def heaps_q(spark, folder, steps: int = 50):
    """Vocabulary met by growing shares of the documents in order of id, and the exponent fitted to it; also the one fitted to the
    first three fifths of the steps, and by how much of itself it misses the whole vocabulary."""
    words = _words(spark, folder)
    top = table(spark, folder, "documents").agg(F.max("doc_id").alias("top"))
    step = F.floor(F.col("doc_id") * steps / (F.col("top") + 1)).alias("step")
    tokens = words.crossJoin(F.broadcast(top)).select(step, "word")
    by = tokens.groupBy("step").agg(F.count("*").alias("n")).join(tokens.groupBy("word").agg(F.min("step").alias("step")).groupBy("step").agg(F.count("*").alias("new")), "step", "left")
    w = W.orderBy("step")  # `steps` rows
    grown = by.select(F.sum("n").over(w).alias("n"), F.sum(F.coalesce("new", F.lit(0))).over(w).alias("v"), (F.col("step") < steps * 0.6).alias("fit"))
    x, y = F.log10("n"), F.log10("v")
    on = lambda c: F.when(F.col("fit"), c)
    got = grown.agg(F.regr_slope(y, x).alias("beta"), F.max("n").alias("tokens"), F.max("v").alias("vocabulary"), F.regr_slope(on(y), on(x)).alias("early"), F.regr_intercept(on(y), on(x)).alias("at"))
    guess = F.pow(F.lit(10.0), F.col("at") + F.col("early") * F.log10("tokens"))
    return got.select(F.round("beta", 6).alias("beta"), "tokens", "vocabulary", F.round("early", 6).alias("beta_early"), F.round(guess / F.col("vocabulary") - 1, 5).alias("held_out_error"))


def bloom_q(spark, folder):
    """False answers of a filter of each user's history to what the user was shown, against the formula's rate."""
    read = table(spark, folder, "user_history").select("user_idx", F.explode("article_idx").alias("article_idx")).where("article_idx is not null").distinct()
    bits = cut(bloom_bits(read, "user_idx", "article_idx"), "bloom")
    shown = impressions(spark, folder).select("user_idx", F.explode("candidates").alias("article_idx")).where("user_idx is not null").distinct()
    probes = shown.join(bits.select("user_idx", "m").distinct(), "user_idx").select("user_idx", "article_idx", F.explode(F.array_distinct(_positions(F.col("article_idx"), F.col("m"), 7))).alias("bit"))
    met = probes.join(bits.select("user_idx", "bit", F.lit(1).alias("set")), ["user_idx", "bit"], "left").groupBy("user_idx", "article_idx").agg((F.count("set") == F.count("*")).alias("yes"))
    truth = met.join(read.withColumn("in", F.lit(True)), ["user_idx", "article_idx"], "left")
    return truth.agg(F.count("*").alias("probes"), F.count_if(F.col("yes") & F.col("in").isNull()).alias("false_yes"), F.count_if(~F.col("yes") & F.col("in").isNotNull()).alias("false_no"), F.round(F.lit((1 - 2.718281828 ** (-7 / 10)) ** 7), 6).alias("formula"))


def count_min_q(spark, folder):
    items = impressions(spark, folder).select(F.explode("candidates").alias("article_idx"))
    exact = items.where("article_idx is not null").groupBy("article_idx").agg(F.count("*").alias("exact"))
    return exact.join(count_min_estimates(exact, "article_idx", count_min(items, "article_idx", width=256), width=256), "article_idx")


def _signed(items: DataFrame, width: int) -> DataFrame:
    """(x, exact, row, cell, sign) of items (x, exact): their counters under each of five rows."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("row"), ((F.col("x") * a + b) % P % width).alias("cell"), F.when((F.col("x") * b + a) % P % 2 == 0, 1).otherwise(-1).alias("sign")) for i, (a, b) in enumerate(seeds(5)))))
    return items.select("x", "exact", cells.alias("c")).select("x", "exact", "c.row", "c.cell", "c.sign")


def count_sketch_q(spark, folder):
    """Median of signed counters, rows hashed as in count-min, signs by the parity of another hash."""
    items = impressions(spark, folder).select(F.explode("candidates").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("exact"))
    spread = _signed(items, 256)
    sketch = spread.groupBy("row", "cell").agg(F.sum(F.col("sign") * F.col("exact")).alias("n"))
    got = spread.join(F.broadcast(sketch), ["row", "cell"]).groupBy("x", "exact").agg(F.sort_array(F.collect_list(F.col("n") * F.col("sign")))[2].alias("estimate"))
    return got.withColumnRenamed("x", "article_idx")


def sketch_sweep_q(spark, folder):
    """Mean relative error of count-min and count-sketch at widths 2^10 to 2^16, over the hundred heaviest keys and over all others."""
    items = impressions(spark, folder).select(F.explode("candidates").alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("exact"))
    top = items.orderBy(F.desc("exact"), "x").limit(100).select("x", F.lit(True).alias("heavy"))
    items = cut(items.join(F.broadcast(top), "x", "left").select("x", "exact", F.coalesce("heavy", F.lit(False)).alias("heavy")), "counts")
    every = None
    for width in (1 << b for b in range(10, 17)):
        spread = _signed(items, width)
        sketch = spread.groupBy("row", "cell").agg(F.sum("exact").alias("plain"), F.sum(F.col("sign") * F.col("exact")).alias("signed"))
        got = spread.join(sketch, ["row", "cell"]).groupBy("x", "exact").agg(F.min("plain").alias("a"), F.sort_array(F.collect_list(F.col("signed") * F.col("sign")))[2].alias("b")).join(items.select("x", "heavy"), "x")
        error = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("exact")) / F.col("exact")), 6)
        one = got.groupBy("heavy").agg(F.lit(width).alias("width"), F.count("*").alias("keys"), error("a").alias("count_min"), error("b").alias("count_sketch"))
        every = one if every is None else every.unionByName(one)
    return every


def hyperloglog_q(spark, folder):
    """Users a day: exact, and whether the sketch is within four of its standard errors."""
    days = impressions(spark, folder, "time is not null and user_idx is not null").groupBy(F.date_format("time", "yyyy-MM-dd").alias("day"))
    return days.agg(F.count_distinct("user_idx").alias("users"), (F.abs(F.approx_count_distinct("user_idx", 0.02) - F.count_distinct("user_idx")) <= F.greatest(0.08 * F.count_distinct("user_idx"), F.lit(1.0))).alias("close"))


def extraction_cost_q(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("docs"), F.sum(F.ceil(F.char_length(F.coalesce("text", F.lit(""))) / 4)).alias("tokens"))


QUERIES = {
    "exact_dedup": exact_dedup_q, "shingles": shingles_q, "exact_jaccard": exact_jaccard_q, "minhash": minhash_q, "lsh_banding": lsh_banding_q, "lsh_verify": lsh_verify_q, "simhash": simhash_q, "hamming": hamming_q, "dup_clusters": dup_clusters_q,
    "zipf": zipf_q, "heaps": heaps_q, "bloom": bloom_q, "count_min": count_min_q, "count_sketch": count_sketch_q, "sketch_sweep": sketch_sweep_q, "recall_canonical": recall_canonical_q, "hyperloglog": hyperloglog_q, "extraction_cost": extraction_cost_q,
}

_TEXTS = """WITH RECURSIVE nt AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL),
dt AS (SELECT min(doc_id) AS id, t FROM nt WHERE t <> '' GROUP BY t), wl AS (SELECT id, string_split(t, ' ') AS w FROM dt),
sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM wl, range(1, len(w) - 3) r(i)), ns AS (SELECT id, count(*) AS n FROM sh GROUP BY 1)"""
_TEXTS = _TEXTS.replace("sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM wl, range(1, len(w) - 3) r(i))", "so AS (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM wl), sh AS (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS s FROM so)")
_JAC = _TEXTS + """, co AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
jac AS (SELECT a, b, c / (x.n + y.n - c) AS j FROM co JOIN ns x ON x.id = a JOIN ns y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9)"""
_HASH = _TEXTS + ", hh AS (SELECT id, CAST(concat('0x', substr(md5(s), 1, 7)) AS BIGINT) AS h FROM sh)"
_SIM = _TEXTS + """, h2 AS (SELECT id, CAST(concat('0x', substr(md5(s), 1, 8)) AS BIGINT) AS hi, CAST(concat('0x', substr(md5(s), 9, 8)) AS BIGINT) AS lo FROM sh),
bits AS (SELECT id, b, sum(CASE WHEN (hi >> b) & 1 = 1 THEN 1 ELSE -1 END) AS vh, sum(CASE WHEN (lo >> b) & 1 = 1 THEN 1 ELSE -1 END) AS vl FROM h2, range(32) r(b) GROUP BY 1, 2),
sim AS (SELECT id, CAST(sum(CASE WHEN vh > 0 THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN vl > 0 THEN 1::BIGINT << b ELSE 0 END) AS BIGINT) AS lo FROM bits GROUP BY 1)"""
_GROUPS = _JAC + f""", ed AS (SELECT a AS x, b AS y FROM jac UNION ALL SELECT b, a FROM jac), reach(x, y) AS (SELECT x, x FROM ed UNION SELECT reach.x, ed.y FROM reach JOIN ed ON ed.x = reach.y),
{IMP}, rc AS (SELECT user_idx, unnest(clicked) AS article_idx, time AS ts FROM imp), pc AS (SELECT article_idx, count(*) AS n FROM (SELECT DISTINCT * FROM rc WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND ts IS NOT NULL) GROUP BY 1),
da AS (SELECT doc_id, min(article_idx) AS article_idx FROM documents GROUP BY 1), dp AS (SELECT doc_id, coalesce(n, 0) AS n FROM da LEFT JOIN pc ON pc.article_idx = da.article_idx),
cn AS (SELECT r.x AS id, arg_min(r.y, (-dp.n, r.y)) AS canonical FROM reach r JOIN dp ON dp.doc_id = r.y GROUP BY 1)"""
_ITEMS = f"WITH {IMP}, o AS (SELECT unnest(candidates) AS x FROM imp), ex AS (SELECT x, count(*) AS exact FROM o WHERE x IS NOT NULL GROUP BY 1), sd(row, a, b) AS (VALUES {', '.join(f'({i}, CAST({a} AS BIGINT), CAST({b} AS BIGINT))' for i, (a, b) in enumerate(seeds(5)))})"
_W = "WITH wd AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' '), ' ')) AS word FROM documents WHERE text IS NOT NULL), ww AS (SELECT * FROM wd WHERE word <> '')"

ORACLES = {
    "exact_dedup": "SELECT sha256(text) AS digest, count(*) AS docs, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "shingles": _TEXTS + " SELECT dt.id, CAST(coalesce(n, 0) AS INT) AS n FROM dt LEFT JOIN ns ON ns.id = dt.id",
    "exact_jaccard": _JAC + " SELECT a, b, round(j, 6) AS jaccard FROM jac",
    "minhash": _HASH + " SELECT id, " + ", ".join(f"min((h * {a} + {b}) % {P}) AS m{i}" for i, (a, b) in enumerate(seeds(8))) + " FROM hh GROUP BY 1",
    "lsh_banding": _HASH + ", mh AS (SELECT id, " + ", ".join(f"min((h * {a} + {b}) % {P}) AS m{i}" for i, (a, b) in enumerate(seeds(BANDS * ROWS))) + " FROM hh GROUP BY 1), bk AS ("
    + " UNION ALL ".join(f"SELECT id, {i} AS band, concat_ws('-', {', '.join(f'm{i * ROWS + j}' for j in range(ROWS))}) AS bucket FROM mh" for i in range(BANDS)) + ") SELECT band, bucket, count(*) AS docs, min(id) AS least FROM bk GROUP BY 1, 2 HAVING count(*) > 1",
    "lsh_verify": _JAC + ", hh AS (SELECT id, CAST(concat('0x', substr(md5(s), 1, 7)) AS BIGINT) AS h FROM sh), mh AS (SELECT id, " + ", ".join(f"min((h * {a} + {b}) % {P}) AS m{i}" for i, (a, b) in enumerate(seeds(BANDS * ROWS))) + " FROM hh GROUP BY 1), v AS (SELECT j, "
    + " OR ".join("(" + " AND ".join(f"x.m{i * ROWS + j} = y.m{i * ROWS + j}" for j in range(ROWS)) + ")" for i in range(BANDS)) + " AS same FROM jac JOIN mh x ON x.id = a JOIN mh y ON y.id = b) SELECT least(floor(j * 20) / 20, 0.95::DOUBLE) AS bin, count(*) AS pairs, count(*) FILTER (same) AS found FROM v GROUP BY 1",
    "simhash": _SIM + " SELECT id, printf('%08x%08x', hi, lo) AS simhash FROM sim",
    "hamming": _SIM.replace(", h2 AS", _JAC[len(_TEXTS):] + ", h2 AS") + " SELECT a, b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INT) AS distance FROM jac JOIN sim x ON x.id = a JOIN sim y ON y.id = b",
    "dup_clusters": _GROUPS + " SELECT cn.id, canonical, links FROM cn JOIN (SELECT x, count(*) AS links FROM ed GROUP BY 1) l ON l.x = cn.id",
    "recall_canonical": _GROUPS + f""", {_BEST}, dn AS (SELECT doc_id, min(article_idx) AS article_idx FROM documents WHERE article_idx IS NOT NULL GROUP BY 1), tt AS (SELECT a.article_idx, min(c.article_idx) AS t FROM cn JOIN dn a ON a.doc_id = cn.id JOIN dn c ON c.doc_id = cn.canonical GROUP BY 1),
        cl AS (SELECT DISTINCT src_row AS imp, user_idx, unnest(clicked) AS a FROM imp WHERE user_idx IS NOT NULL AND time >= TIMESTAMP '{CUTOFF}'), ls AS (SELECT user_idx, article_idx AS a FROM fr WHERE rank <= 10),
        cc AS (SELECT DISTINCT imp, user_idx, coalesce(t, a) AS a FROM cl LEFT JOIN tt ON tt.article_idx = a WHERE a IS NOT NULL), lc AS (SELECT DISTINCT user_idx, coalesce(t, a) AS a FROM ls LEFT JOIN tt ON tt.article_idx = a),
        e1 AS (SELECT cl.imp, avg(CAST(ls.a IS NOT NULL AS INT)) AS r FROM cl LEFT JOIN ls ON ls.user_idx = cl.user_idx AND ls.a = cl.a WHERE cl.a IS NOT NULL GROUP BY 1), e2 AS (SELECT cc.imp, avg(CAST(lc.a IS NOT NULL AS INT)) AS r FROM cc LEFT JOIN lc ON lc.user_idx = cc.user_idx AND lc.a = cc.a GROUP BY 1)
        SELECT 'as they are' AS ids, count(*) AS impressions, round(avg(r), 6) AS recall FROM e1 UNION ALL SELECT 'canonical', count(*), round(avg(r), 6) FROM e2""",
    "zipf": _W + ", c AS (SELECT word, count(*) AS n FROM ww GROUP BY 1), f AS (SELECT n, count(*) AS words FROM c GROUP BY 1), r AS (SELECT n, words, sum(words) OVER (ORDER BY n DESC) AS rank FROM f) SELECT round(regr_slope(log10(n), log10(rank)), 6) AS slope, round(sum(words) FILTER (n = 1) / sum(words), 6) AS hapax_share, CAST(sum(words) AS BIGINT) AS vocabulary FROM r",
    "heaps": _W + """, t AS (SELECT CAST(floor(doc_id * 50 / ((SELECT max(doc_id) FROM documents) + 1)) AS BIGINT) AS step, word FROM ww), n AS (SELECT step, count(*) AS n FROM t GROUP BY 1), v AS (SELECT step, count(*) AS v FROM (SELECT word, min(step) AS step FROM t GROUP BY 1) GROUP BY 1),
        g AS (SELECT sum(n) OVER (ORDER BY n.step) AS n, sum(coalesce(v, 0)) OVER (ORDER BY n.step) AS v, n.step < 30 AS fit FROM n LEFT JOIN v ON v.step = n.step),
        f AS (SELECT regr_slope(log10(v), log10(n)) AS beta, max(n) AS n, max(v) AS v, regr_slope(log10(v), log10(n)) FILTER (fit) AS early, regr_intercept(log10(v), log10(n)) FILTER (fit) AS base FROM g)
        SELECT round(beta, 6) AS beta, CAST(n AS BIGINT) AS tokens, CAST(v AS BIGINT) AS vocabulary, round(early, 6) AS beta_early, round(pow(10, base + early * log10(n)) / v - 1, 5) AS held_out_error FROM f""",
    "count_min": _ITEMS + ", ce AS (SELECT x, exact, row, (x * a + b) % 2147483647 % 256 AS cell FROM ex, sd), sk AS (SELECT row, cell, sum(exact) AS n FROM ce GROUP BY 1, 2) SELECT x AS article_idx, exact, CAST(min(n) AS BIGINT) AS estimate FROM ce JOIN sk ON sk.row = ce.row AND sk.cell = ce.cell GROUP BY 1, 2",
    "count_sketch": _ITEMS + ", ce AS (SELECT x, exact, row, (x * a + b) % 2147483647 % 256 AS cell, CASE WHEN (x * b + a) % 2147483647 % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ex, sd), sk AS (SELECT row, cell, sum(sign * exact) AS n FROM ce GROUP BY 1, 2) SELECT x AS article_idx, exact, CAST(median(n * sign) AS BIGINT) AS estimate FROM ce JOIN sk ON sk.row = ce.row AND sk.cell = ce.cell GROUP BY 1, 2",
    "sketch_sweep": _ITEMS + """, wd(width) AS (SELECT CAST(1 << b AS INT) FROM range(10, 17) r(b)), hv AS (SELECT x FROM ex ORDER BY exact DESC, x LIMIT 100), ce AS (SELECT width, x, exact, row, (x * a + b) % 2147483647 % width AS cell, CASE WHEN (x * b + a) % 2147483647 % 2 = 0 THEN 1 ELSE -1 END AS sign FROM ex, sd, wd),
        sk AS (SELECT width, row, cell, sum(exact) AS p, sum(sign * exact) AS s FROM ce GROUP BY 1, 2, 3), es AS (SELECT ce.width, x, exact, min(p) AS a, median(s * sign) AS b FROM ce JOIN sk ON sk.width = ce.width AND sk.row = ce.row AND sk.cell = ce.cell GROUP BY 1, 2, 3)
        SELECT x IN (SELECT x FROM hv) AS heavy, width, count(*) AS keys, round(avg(abs(a - exact) / exact), 6) AS count_min, round(avg(abs(b - exact) / exact), 6) AS count_sketch FROM es GROUP BY 1, 2""",
    "hyperloglog": f"WITH {IMP} SELECT strftime(time, '%Y-%m-%d') AS day, count(DISTINCT user_idx) AS users, true AS close FROM imp WHERE time IS NOT NULL AND user_idx IS NOT NULL GROUP BY 1",
    "extraction_cost": "SELECT source, count(*) AS docs, CAST(sum(ceil(length(coalesce(text, '')) / 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1",
}
