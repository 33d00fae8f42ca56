"""Occurrences and document counts of every term, over a vertical layout of compressed record-identifier bitmaps."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.plans.cut import spread
from clicklake.sources.tables import table

TERM = regex.compile(r"[\p{L}\p{N}]+")
SPAN = 1 << 16
#: From so many members on, a bitmap of 8 KB is smaller than the list of 16-bit members.
DENSE = SPAN // 16


def terms(text: str) -> list[str]:
    """The longest runs of letters and digits of the lower-cased text, two or more characters, not decimal digits only."""
    return [t for t in TERM.findall(text.lower()) if len(t) > 1 and not t.isdecimal()]


def pack(members: np.ndarray) -> bytes:
    """A container of sorted distinct 16-bit members: the members, or a bitmap of 8 KB if that is smaller."""
    if len(members) < DENSE:
        return members.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[members] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes) -> np.ndarray:
    """The members of a container, sorted."""
    if len(data) == SPAN // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")).astype(np.uint16)
    return np.frombuffer(data, "<u2")


def _containers(term: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """(term, span, container, occurrences) of each term and span, from a row for each document of a term; ids may repeat."""
    order = np.lexsort((ids, term))
    term, ids, n = term[order], ids[order], n[order]
    span = ids >> 16
    new = np.concatenate([[True], (term[1:] != term[:-1]) | (span[1:] != span[:-1])])
    first = np.flatnonzero(new)
    own = np.concatenate([[True], new[1:] | (ids[1:] != ids[:-1])])  # the first row of each document
    low = (ids[own] & 0xFFFF).astype("<u2")
    at = np.append(np.cumsum(own)[first] - 1, len(low))
    whole = low.tobytes()
    data = [whole[2 * i : 2 * j] if j - i < DENSE else pack(low[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    return term[first], span[first], data, np.add.reduceat(n, first)


def _layout(chunk_chars: int):
    """Of each chunk of documents: per term and span of 65,536 ids a container and the occurrences in it."""

    def emit(numbers: dict[str, int], rows: tuple[array, array, array]) -> Iterator[pa.RecordBatch]:
        if not numbers:
            return
        names = list(numbers)
        term, span, data, n = _containers(*(np.frombuffer(x, np.int64) for x in rows))
        for i in range(0, len(term), 1 << 15):
            k = slice(i, i + (1 << 15))
            yield pa.RecordBatch.from_arrays([pa.array([names[t] for t in term[k].tolist()], pa.string()), pa.array(span[k]), pa.array(data[k], pa.binary()), pa.array(n[k])], ["term", "span", "ids", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        rows = array("q"), array("q"), array("q")
        size = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = Counter(terms(text))
                rows[0].extend([numbers.setdefault(t, len(numbers)) for t in counts])
                rows[1].extend([i] * len(counts))
                rows[2].extend(counts.values())
                size += len(text)
                if size >= chunk_chars:
                    yield from emit(numbers, rows)
                    numbers, rows, size = {}, (array("q"), array("q"), array("q")), 0
        yield from emit(numbers, rows)

    return run


def _cardinalities(data: list[bytes], group: np.ndarray, groups: int) -> np.ndarray:
    """How many members the union of each group's containers has."""
    dense = np.array([len(x) == SPAN // 8 for x in data], bool)
    plain = [x for x, d in zip(data, dense) if not d]
    keys = [np.repeat(group[~dense], [len(x) // 2 for x in plain]) << 16 | np.frombuffer(b"".join(plain), "<u2").astype(np.int64)]
    for i in np.flatnonzero(dense):
        keys.append(group[i] << 16 | unpack(data[i]).astype(np.int64))
    return np.bincount(np.unique(np.concatenate(keys)) >> 16, minlength=groups)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (term, span): containers of one term and span are united, counters added."""

    def merge(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        term, span = rows["term"].combine_chunks(), rows["span"].to_numpy()
        new = np.ones(len(span), bool)
        new[1:] = pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) | (span[1:] != span[:-1])
        first = np.flatnonzero(new)
        df = _cardinalities(rows["ids"].to_pylist(), np.cumsum(new, dtype=np.int64) - 1, len(first))
        return pa.RecordBatch.from_arrays([term.take(pa.array(first)), pa.array(np.add.reduceat(rows["n"].to_numpy(), first)), pa.array(df)], ["term", "tf", "df"])

    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        last = (rows["term"][-1], rows["span"][-1])
        i = rows.num_rows - 1
        while i and (rows["term"][i - 1], rows["span"][i - 1]) == last:
            i -= 1
        if i:
            yield merge(rows.slice(0, i))
        held = rows.slice(i)
        if held.num_rows > 256:  # keep what is carried on small: unite it now
            m = np.unique(np.concatenate([unpack(x) for x in held["ids"].to_pylist()]))
            held = pa.table({"term": [last[0].as_py()], "span": [last[1].as_py()], "ids": [pack(m)], "n": [int(held["n"].to_numpy().sum())]}, schema=held.schema)
    if held is not None:
        yield merge(held)


def term_counts(docs: DataFrame, doc_id: str, text: str, rare: int = 2, common: float = 0.25, chunk_chars: int = 4_000_000) -> DataFrame:
    """(term, tf, df, mark) of every term: occurrences, number of documents, and 'rare', 'common' or null.

    Rare is a term of at most `rare` documents, else common if of more than that share of the documents whose text is
    neither null nor empty. Null texts have no terms; rows with a null id are left out. A repeated row adds occurrences but
    no document: a bitmap holds an id once. Any number of terms, texts of any length.

    Each input partition builds, for chunks of bounded size, a container of document ids per term and span of 65,536 ids
    with a counter of occurrences beside it; containers meet by (term, span), are united, and their cardinalities added.
    So even a term in every document has at most one container a chunk to shuffle, spread over the spans.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null and text <> ''")
    laid = spread(rows).mapInArrow(_layout(chunk_chars), "term string, span bigint, ids binary, n bigint")
    parts = laid.repartition("term", "span").sortWithinPartitions("term", "span").mapInArrow(_union, "term string, tf bigint, df bigint")
    total = rows.agg(F.count("*").alias("docs"))
    found = parts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).crossJoin(F.broadcast(total))
    mark = F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.col("docs") * common, "common")
    return found.select("term", "tf", "df", mark.alias("mark"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return term_counts(table(spark, folder, "documents"), "doc_id", "text").where("mark is not null").select("term", "mark")


def p7_terms(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and documents of every term."""
    return term_counts(table(spark, folder, "documents"), "doc_id", "text")


QUERIES = {"p7_found": p7_found, "p7_terms": p7_terms}

_TERMS = r"""
WITH n AS (SELECT count(*) AS docs FROM documents WHERE text <> ''),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
c AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t WHERE length(term) > 1 AND NOT regexp_full_match(term, '\p{Nd}+') GROUP BY 1),
m AS (SELECT c.*, CASE WHEN df <= 2 THEN 'rare' WHEN df * 4 > docs THEN 'common' END AS mark FROM c, n)
"""

ORACLES = {"p7_found": _TERMS + "SELECT term, mark FROM m WHERE mark IS NOT NULL", "p7_terms": _TERMS + "SELECT term, tf, df, mark FROM m"}
