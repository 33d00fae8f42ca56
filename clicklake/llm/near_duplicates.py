"""Groups of texts that differ by small edits, by multi-index hashing of min-hash fingerprints.

A fingerprint is a string of 144 symbols. One hash of each of the text's character stretches deals them over 144 bins, and a
symbol is the smallest hash in its bin; an empty bin takes the symbol of another, the same for every text. Two texts agree
in a symbol with the probability of their similarity, so the Hamming distance of fingerprints tells it. The fingerprint is
cut into 24 segments of 6 symbols. Over symbols of 16 bits the Hamming ball of radius 1 about a segment is enumerated by
leaving out each of its symbols in turn: texts within distance 1 in some segment share a table entry. Matches of the tables
are verified by the distance of the complete fingerprints, then by the exact similarity. At similarity 0.6 a segment is hit
with probability 0.23, one of 24 with 0.998; at 0.1 with 0.001.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.plans.cut import cut, drop, spread
from clicklake.plans.graph import components
from clicklake.sources.tables import table

STRETCH, SEGMENTS, WIDTH = 9, 24, 6
SYMBOLS = SEGMENTS * WIDTH
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: For each bin the bins it asks in turn when empty, and where it starts to go round when those are empty too.
_ASKED = (_mix(np.arange(1, 33 * SYMBOLS + 1, dtype=U)).reshape(33, SYMBOLS) % U(SYMBOLS)).astype(np.int64)
_BLANKS = re.compile("[ \t\r\n]+")


def normal(text: str) -> str:
    """Lower case, each run of blanks one space, trimmed."""
    return _BLANKS.sub(" ", text.lower()).strip(" ")


def stretch_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all 9-character stretches of the texts, each of 9 characters at least, and where each text starts."""
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    h = np.zeros(len(codes) - STRETCH + 1, U)
    for j in range(STRETCH):
        h *= U(0x9E3779B97F4A7C15)
        h += codes[j : j + len(h)] + U(1)
    ends = np.cumsum(sizes)
    own = np.ones(len(h), bool)
    for back in range(1, STRETCH):
        cross = ends - back
        own[cross[cross < len(h)]] = False
    starts = np.concatenate([[0], np.cumsum(sizes - STRETCH + 1)[:-1]])
    return _mix(h[own]), starts


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of symbols for each text, each of 9 characters at least."""
    out = np.empty((len(texts), SYMBOLS), np.uint16)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 17):
            size += len(texts[j])
            j += 1
        h, starts = stretch_hashes(texts[i:j])
        owner = np.repeat(np.arange(j - i), np.diff(np.append(starts, len(h))))
        least = np.full((j - i) * SYMBOLS, 0xFFFFFFFF, np.uint32)
        np.minimum.at(least, owner * SYMBOLS + ((h >> U(48)) * U(SYMBOLS) >> U(16)).astype(np.int64), (h & U(0xFFFFFFFF)).astype(np.uint32))
        out[i:j] = _mix(_filled(least.reshape(j - i, SYMBOLS)).astype(U)) >> U(48)
        i = j
    return out


def _filled(least: np.ndarray) -> np.ndarray:
    """Empty bins take what the first filled bin they ask has; every row has a filled one."""
    out, empty = least.copy(), np.uint32(0xFFFFFFFF)
    row, at = np.nonzero(least == empty)
    for step in range(len(_ASKED) - 1 + SYMBOLS):
        if not len(row):
            break
        asked = _ASKED[min(step, len(_ASKED) - 1), at]
        asked = asked if step < len(_ASKED) else (asked + step - len(_ASKED) + 1) % SYMBOLS
        got = least[row, asked]
        out[row, at] = got
        still = got == empty
        row, at = row[still], at[still]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest, symbols); of copies within a batch the first has the symbols."""
    for b in batches:
        ids, texts, digests, at = [], [], [], {}
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            t = normal(t)
            if len(t) >= STRETCH:
                d = hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if d not in at:
                    at[d] = len(ids)
                    texts.append(t)
                ids.append(i)
                digests.append(d)
        if ids:
            symbols: list[bytes | None] = [None] * len(ids)
            for k, row in zip(at.values(), fingerprints(texts)):
                symbols[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(symbols, pa.binary())], ["doc_id", "digest", "symbols"])


def _symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def table_keys(symbols: np.ndarray) -> np.ndarray:
    """For each fingerprint the keys of the radius-1 balls of all its segments; the low 5 bits of a key are its segment."""
    place = _mix(np.arange(SYMBOLS, dtype=U) + U(7)).reshape(SEGMENTS, WIDTH)
    each = _mix(symbols.reshape(-1, SEGMENTS, WIDTH).astype(U) ^ place)
    keys = _mix(each.sum(axis=2, dtype=U, keepdims=True) - each + place) & ~U(31)
    return (keys | np.arange(SEGMENTS, dtype=U)[:, None]).reshape(len(symbols), SYMBOLS)


def _entries(keys: np.ndarray, reps: np.ndarray, parts: int) -> pa.RecordBatch:
    """Table entries packed by the part their key belongs to: (part, keys, reps, company), a row a part.

    Of entries that share a key here, all are sure to have company, and all but the first may lie in any part, so that a hot
    key fills none.
    """
    order = np.argsort(keys, kind="stable")
    keys, reps = keys[order], reps[order]
    again = np.concatenate([[False], keys[1:] == keys[:-1]])
    company = again | np.concatenate([again[1:], [False]])
    part = (_mix(np.where(again, keys ^ _mix(reps.view(U)), keys)) % U(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part, keys, reps, company = part[order], keys[order], reps[order], company[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
    ends = np.append(at[1:], len(part))
    packed = [pa.array([x[i:j].tobytes() for i, j in zip(at, ends)], pa.binary()) for x in (keys, reps, company)]
    return pa.RecordBatch.from_arrays([pa.array(part[at]), *packed], ["part", "keys", "reps", "company"])


def _keys(parts: int, chunk: int = 4096):
    """The entries of each fingerprint (rep, symbols), `chunk` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, chunk):
                part = b.slice(i, chunk)
                yield _entries(table_keys(_symbols(part.column(1))).reshape(-1), np.repeat(part.column(0).to_numpy(), SYMBOLS), parts)

    return run


def _finer(parts: int, chunk: int = 4096):
    """The entries of (rep, symbols, key) with each ball of a later segment than the key's own beside that key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, chunk):
                part = b.slice(i, chunk)
                balls, key = table_keys(_symbols(part.column(1))), part.column(2).to_numpy().view(U)
                later = (balls & U(31)) > (key & U(31))[:, None]
                both = _mix(_mix(key)[:, None] ^ balls) & ~U(31) | balls & U(31)
                yield _entries(both[later], np.repeat(part.column(0).to_numpy(), later.sum(axis=1)), parts)

    return run


def _pairs(reps: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (a < b) within runs of `reps` that start at `first` and have these sizes."""
    a, b = [], []
    for n in np.unique(sizes):
        members = reps[first[sizes == n][:, None] + np.arange(n)]
        i, j = np.triu_indices(n, 1)
        a.append(np.minimum(members[:, i], members[:, j]).reshape(-1))
        b.append(np.maximum(members[:, i], members[:, j]).reshape(-1))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    keep = (x != y) & np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    return x[keep], y[keep]


def _met(hot: int):
    """From packed entries whose parts stand together, those with company: as pairs (rep, mate) where all texts of a key are
    here and at most `hot`, else as (key, rep)."""

    def out(held: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys, reps, company = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*held), (U, np.int64, bool)))
        order = np.argsort(keys, kind="stable")
        keys, reps, company = keys[order], reps[order], company[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        sizes = np.diff(np.append(first, len(keys)))
        some = np.add.reduceat(company, first, dtype=np.int64) > 0 if len(keys) else sizes > 0
        whole = ~some & (sizes > 1) & (sizes <= hot)
        a, b = _pairs(reps, first[whole], sizes[whole])
        rest = np.flatnonzero(np.repeat(some | (sizes > hot), sizes))
        for x, y, z in ((None, a, b), (keys[rest].view(np.int64), reps[rest], None)):
            for i in range(0, len(y), 1 << 16):
                k = slice(i, i + (1 << 16))
                none = pa.nulls(len(y[k]), pa.int64())
                yield pa.RecordBatch.from_arrays([none if x is None else pa.array(x[k]), pa.array(y[k]), none if z is None else pa.array(z[k])], ["key", "rep", "mate"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes]] = []
        of: int | None = None
        for b in batches:
            for part, *packed in zip(*(c.to_pylist() for c in b.columns)):
                if held and part != of:
                    yield from out(held)
                    held = []
                of = part
                held.append(tuple(packed))
        if held:
            yield from out(held)

    return run


def _company(texts: DataFrame, entries, n: int, hot: int, together: int = 2_000_000) -> DataFrame:
    """(key, rep, mate): pairs of texts that share an entry, or where not all of a key meet in one part or they are more than
    `hot`, the entries. n texts make them, and a part holds about `together` of them."""
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-n * SYMBOLS // together))
    packed = texts.mapInArrow(entries(parts), "part int, keys binary, reps binary, company binary")
    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_met(hot), "key bigint, rep bigint, mate bigint")


def _close(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                keep = (_symbols(b.column(2)) == _symbols(b.column(3))).mean(axis=1) >= least
                yield b.select([0, 1]).filter(pa.array(keep))

    return run


def _exact(threshold: float, hold: int = 2_000_000):
    """Pairs (a, b, text_a, text_b) of at least this similarity; stretches are told apart by their 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        held = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                a, c, s, t = (x.to_pylist() for x in part.columns)
                if held > hold:
                    sets.clear()
                    held = 0
                new = {i: x for i, x in zip(a + c, s + t) if i not in sets}
                if new:
                    h, starts = stretch_hashes([normal(x) for x in new.values()])
                    for i, own in zip(new, np.split(h, starts[1:])):
                        sets[i] = np.unique(own)
                        held += len(sets[i])
                keep = []
                for i, j in zip(a, c):
                    both = np.sort(np.concatenate([sets[i], sets[j]]))
                    n = int((both[1:] == both[:-1]).sum())
                    keep.append(n >= threshold * (len(both) - n) - 1e-9)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def verified(pairs: DataFrame, prints: DataFrame, texts: DataFrame, threshold: float, keep=cut) -> DataFrame:
    """Of candidate pairs (a, b), those whose texts are as similar as `threshold`.

    Complete fingerprints come first: pairs six standard deviations of the estimate under the threshold are dropped.
    """
    sd = (threshold * (1 - threshold) / SYMBOLS) ** 0.5
    x, y = prints.toDF("a", "print_a"), prints.toDF("b", "print_b")
    close = pairs.join(x, "a").join(y, "b").select("a", "b", "print_a", "print_b").mapInArrow(_close(threshold - 6 * sd), "a bigint, b bigint")
    close = keep(close, "close")
    ids = close.select(F.col("a").alias("id")).union(close.select("b")).distinct()
    used = texts.join(ids, "id", "left_semi")
    met = close.join(used.toDF("a", "text_a"), "a").join(used.toDF("b", "text_b"), "b")
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_exact(threshold), "a bigint, b bigint").distinct()


def candidates(shared: DataFrame, labels: DataFrame | None, hot: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, large): pairs (a, b) to verify from what `_company` gives, and the entries (key, rep) of more than `hot` texts.

    An entry of up to `hot` texts gives all its pairs, a larger one those with one of its texts, drawn by key. Pairs within a
    label (node, label) are left out.
    """
    direct = shared.where("mate is not null").select(F.col("rep").alias("a"), F.col("mate").alias("b"))
    shared = shared.where("mate is null").select("key", "rep")
    sizes = shared.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", "rep"), "rep"))["rep"].alias("hub"))
    entries = shared.join(sizes.where("n > 1"), "key")
    lists = entries.where(F.col("n") <= hot).groupBy("key").agg(F.sort_array(F.collect_set("rep")).alias("reps")).select("reps").distinct()
    pairs = lists.select(F.explode(F.expr("flatten(transform(reps, (x, i) -> transform(slice(reps, i + 2, size(reps)), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    spokes = entries.where((F.col("n") > hot) & (F.col("rep") != F.col("hub"))).select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b"))
    pairs = direct.union(pairs).union(spokes).distinct()
    if labels is not None:
        x, y = (labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in ("a", "b"))
        pairs = pairs.join(x, "a", "left").join(y, "b", "left").where("not coalesce(of_a, a) = coalesce(of_b, b)").select("a", "b")
    return pairs, entries.where(F.col("n") > hot).select("key", "rep")


def unresolved(large: DataFrame, labels: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """(pairs, rest): what entries (key, rep) of several labels still leave open.

    An entry with at most `few` texts outside its largest label gives each of them with every text of another label: pairs
    (a, b), after which it is settled. The other entries are the rest.
    """
    of = large.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    by = of.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), (F.sum("count") - F.max("count")).alias("out")).where("out > 0")
    met = of.join(by, "key")
    outside = met.where((F.col("out") <= few) & (F.col("label") != F.col("main"))).select("key", F.col("rep").alias("x"), F.col("label").alias("of_x"))
    pairs = outside.join(of, "key").where("label <> of_x").select(F.least("x", "rep").alias("a"), F.greatest("x", "rep").alias("b")).distinct()
    return pairs, met.where(F.col("out") > few).select("key", "rep")


def near_duplicates(docs: DataFrame, doc_id: str, text: str, threshold: float = 0.6, hot: int = 32, few: int = 64) -> DataFrame:
    """(doc_id, canonical) of each document that shares a group with another: texts of at least this similarity are linked,
    groups are what links connect, canonical is the smallest id of the group.

    Similarity is the Jaccard of the sets of 9-character stretches of the normalised texts. Null ids, null texts and texts
    under 9 characters are in no group. Exact copies (after normalising) are collapsed first and carried by the smallest
    id. Repeated rows of a document count once; a document of several texts is in the group of any of them.

    A table entry of up to `hot` texts gives all its pairs. Of a larger one, all are held against one of its texts. What that
    and the other links leave in several groups goes on: up to `few` texts outside the entry's largest group are held against
    all the others not of their own; else its texts meet again in finer entries, whose key has a ball of a later segment
    beside that of the entry, and so on until entries are small or settled. So a large family is never spelled out in pairs,
    and unlike texts that share a segment by common boilerplate part after few rounds. The tables between the stages are
    deleted as soon as the result is written.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(cut(df, name))
        return made[-1]

    rows = spread(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null"))
    sketched = keep(rows.mapInArrow(_sketch, "doc_id bigint, digest binary, symbols binary"), "sketch")
    reps = keep(sketched.groupBy("digest").agg(F.min("doc_id").alias("rep"), (F.max("doc_id") > F.min("doc_id")).alias("copied"), F.max("symbols").alias("symbols")), "reps")
    prints = reps.select("rep", "symbols")
    shared = keep(_company(prints, _keys, reps.count(), hot), "shared")
    pairs, large = candidates(shared, None, hot)
    labels = keep(components(keep(verified(pairs, prints, rows, threshold, keep), "links")), "labels")
    for _ in range(SEGMENTS):
        pairs, rest = (keep(x, "open") for x in unresolved(large, labels, few))
        n = rest.count()
        if n:
            shared = keep(_company(prints.join(rest, "rep").select("rep", "symbols", "key"), _finer, n, hot), "shared")
            finer, large = candidates(shared, labels, hot)
            pairs = pairs.union(finer).distinct()
        elif pairs.isEmpty():
            break
        links = keep(verified(pairs, prints, rows, threshold, keep), "links")
        if not links.isEmpty():
            labels = keep(components(links.union(labels.where("node <> label").toDF("a", "b"))), "labels")
        if not n:
            break

    classes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").where("copied or label is not null").select("digest", F.coalesce("label", "rep").alias("canonical"))
    out = cut(sketched.select("doc_id", "digest").join(classes, "digest").select("doc_id", "canonical").distinct(), "groups")
    for t in made:
        drop(t)
    return out


def group_pairs(groups: DataFrame, block: int = 2000) -> DataFrame:
    """All pairs (doc_id_a < doc_id_b) of a group; the members of a large group are dealt into blocks that many tasks share."""
    sizes = groups.groupBy("canonical").count().where("count > 1").select("canonical", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    many = groups.join(sizes, "canonical")
    left = many.select("canonical", F.col("doc_id").alias("doc_id_a"), F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"))
    right = many.select("canonical", F.col("doc_id").alias("doc_id_b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return left.join(right, ["canonical", "block"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of documents in one group."""
    return group_pairs(near_duplicates(table(spark, folder, "documents"), "doc_id", "text"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each document of a group with its canonical member and the group's size."""
    groups = near_duplicates(table(spark, folder, "documents"), "doc_id", "text")
    sizes = groups.groupBy("canonical").agg(F.count("*").alias("members"))
    return groups.join(sizes, "canonical").where("members > 1").select("doc_id", "canonical", "members")


QUERIES = {"p1_found": p1_found, "p1_groups": p1_groups}

#: All pairs of texts that share a stretch are counted: for small tables only, as the driver's.
_GROUPS = """
WITH RECURSIVE nt AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
dt AS (SELECT min(doc_id) AS id, t FROM nt WHERE length(t) >= 9 GROUP BY t), op AS (SELECT id, t, unnest(range(1, length(t) - 7)) AS i FROM dt), sh AS (SELECT DISTINCT id, hash(substr(t, i, 9)) AS s FROM op), ns AS (SELECT id, count(*) AS n FROM sh GROUP BY 1),
co AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2), jac AS (SELECT a, b FROM co JOIN ns x ON x.id = a JOIN ns y ON y.id = b WHERE c >= 0.6 * (x.n + y.n - c) - 1e-9),
ed AS (SELECT a AS x, b AS y FROM jac UNION ALL SELECT b, a FROM jac), reach(x, y) AS (SELECT x, x FROM ed UNION SELECT reach.x, ed.y FROM reach JOIN ed ON ed.x = reach.y), lb AS (SELECT x AS id, min(y) AS label FROM reach GROUP BY 1),
gr AS (SELECT nt.doc_id, coalesce(label, dt.id) AS canonical FROM nt JOIN dt ON dt.t = nt.t LEFT JOIN lb ON lb.id = dt.id)
"""

ORACLES = {
    "p1_found": _GROUPS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM gr a JOIN gr b ON a.canonical = b.canonical AND a.doc_id < b.doc_id",
    "p1_groups": _GROUPS + ", g AS (SELECT DISTINCT * FROM gr) SELECT doc_id, canonical, count(*) OVER (PARTITION BY canonical) AS members FROM g QUALIFY count(*) OVER (PARTITION BY canonical) > 1",
}
