"""Statistics of text quality, and prose told from other content by the labels a hidden Markov model gives to lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.llm.line_model import LABELS, LineModel, estimate
from clicklake.llm.lines import BINS, Lines, measure, word_hashes
from clicklake.plans.cut import cut, drop, spread
from clicklake.sources.tables import table

#: Frequent function words of English, Danish, Swedish and German. Fixed values.
COMMON = tuple(
    """the of and to in a is that for it was on are as with be has had at by from have been this which not or an said who when will his her their its they would more than were but what
    og i at det er en den til af som på de med han for ikke der var et sig har om vi så blev efter hvor siden fra nu skal mere hvem ingen sådan
    och att det är som på den av med för har ett till från blev när om efter bara eller ska men enligt vem nu inte
    und der die das in den von zu mit sich ist des ein eine nicht auf dem es an als auch nach wie bei aus wurde wer was sie sind hat wenn war jetzt einem""".split()
)
STATISTICS = ("words", "mean_word", "symbol_ratio", "end_share", "common_share", "lines", "chars")
#: Texts are measured together up to so many characters; a longer one in blocks, cut at a line end or a blank.
TOGETHER = 1 << 18


def _parts(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray, int, int]]:
    """Groups of texts as (parts, the text of each part, first text, texts); only a text above TOGETHER has several parts."""
    i = 0
    while i < len(texts):
        parts, owner, size, j = [], [], 0, i
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= TOGETHER):
            t = texts[j] or ""
            at = 0
            while at < len(t) or at == 0:
                end = at + TOGETHER
                if end < len(t):
                    cut = max(t.rfind("\n", at, end), t.rfind("\r", at, end))
                    cut = cut if cut > at else t.rfind(" ", at, end)
                    end = cut if cut > at else end
                parts.append(t[at:end])
                owner.append(j - i)
                at = max(end, 1)
            size += len(t)
            j += 1
        yield parts, np.array(owner), i, j - i
        i = j


def measured(texts: list[str | None], familiar: np.ndarray | None = None) -> Iterator[tuple[int, int, Lines, np.ndarray]]:
    """(first text, texts, lines, statistics) of consecutive groups; the lines' `doc` counts from the group's first text."""
    common = word_hashes(COMMON)
    for parts, owner, first, n in _parts(texts):
        m = measure(parts, common, common if familiar is None else familiar)
        sums = {c: np.bincount(owner, getattr(m, c), n) for c in ("words", "word_chars", "common", "solid", "symbols", "lines", "ended")}
        m.doc = owner[m.doc]
        one = lambda c: np.maximum(sums[c], 1)
        chars = np.array([len((t or "").strip()) for t in texts[first : first + n]], float)
        yield first, n, m, np.column_stack([sums["words"], sums["word_chars"] / one("words"), sums["symbols"] / one("solid"), sums["ended"] / one("lines"), sums["common"] / one("words"), sums["lines"], chars])


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one text."""
    return next(measured([text]))[3][0].tolist()


def _measure(model: LineModel | None, familiar: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, m, stats in measured(b.column(1).to_pylist(), familiar):
                columns, names = list(stats.T), list(STATISTICS)
                if model is not None:
                    columns += list(model.shares(n, m.doc, m.codes, m.weight).T)
                    names += LABELS
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), *(pa.array(np.ascontiguousarray(c)) for c in columns)], ["id", *names])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))


def text_statistics(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, *STATISTICS) of every row, computed where it lies; null, empty and blank texts have 0 everywhere.

    A word starts with a letter and goes on over letters, marks, hyphens and apostrophes. `symbol_ratio` is the share of
    characters other than blanks that belong to no word and are no digits; lines of blanks alone are none; a line ends in
    punctuation if a stop, a question or exclamation mark, an ellipsis or a colon ends it, up to two closing quotes or
    brackets aside; `common_share` counts the words of COMMON; `chars` is the length without outer blanks.
    """
    rows = spread(_rows(docs, doc_id, text))
    return rows.mapInArrow(_measure(None, None), f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} double" for c in STATISTICS))


def label_shares(docs: DataFrame, doc_id: str, text: str, model: LineModel, familiar: np.ndarray) -> DataFrame:
    """(id, *STATISTICS, prose, list, table, junk) of every row: the statistics, and the labels' shares in its characters."""
    rows = spread(_rows(docs, doc_id, text))
    return rows.mapInArrow(_measure(model, familiar), f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{c} double" for c in (*STATISTICS, *LABELS)))


def _coded(familiar: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, m, _ in measured(b.column(1).to_pylist(), familiar):
                at = np.searchsorted(m.doc, np.arange(n + 1))
                codes = [m.codes[x:y].tobytes() for x, y in zip(at, at[1:])]
                weights = [m.weight[x:y].astype(np.int64).tobytes() for x, y in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, n), b.column(2).slice(first, n), pa.array(codes, pa.binary()), pa.array(weights, pa.binary())], ["id", "y", "codes", "weights"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, is_prose: str, sample: int = 20_000, words: int = 2_000) -> tuple[LineModel, np.ndarray]:
    """The line model, and hashes of the familiar words, from at most `sample` judged documents (of the smallest hashes of ids).

    Rows judged twice count once, contradictory or null verdicts not at all. Familiar words are the at most `words` commonest
    in the prose documents, each in a hundredth and three of them at least; so any language the judges met is known. Without
    verdicts as many documents without any are taken, COMMON is what is familiar, and half the characters must be prose.
    What comes to the driver are a few bytes a line of the sample.
    """
    labels = labels.select(F.col(doc_id).alias("id"), F.col(is_prose).cast("double").alias("y")).where("id is not null and y is not null")
    labels = labels.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").orderBy(F.xxhash64("id"), "id").limit(sample).select("id", "y")
    rows = _rows(docs, doc_id, text).where("text is not null")
    judged = cut(rows.join(F.broadcast(labels), "id").select("id", "text", "y"), "judged")  # at most `sample` ids; the corpus is read once
    prose = judged.where("y = 1")
    seen = prose.select("id", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(text), '(\\p{L}[\\p{L}\\p{M}\'’\\-]*)', 1)"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = seen.orderBy(F.desc("n"), "word").limit(words).collect()
    if found:
        n = prose.count()
        familiar = word_hashes(r["word"] for r in found if r["n"] >= max(3, 0.01 * n))
    else:
        familiar = word_hashes(COMMON)
    schema = f"id {dict(rows.dtypes)['id']}, y double, codes binary, weights binary"
    coded = judged.mapInArrow(_coded(familiar), schema).toArrow()
    if not coded.num_rows:
        some = rows.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample).distinct()
        drop(judged)
        judged = cut(rows.join(F.broadcast(some), "id").select("id", "text", F.lit(None).cast("double").alias("y")), "judged")
        coded = judged.mapInArrow(_coded(familiar), schema).toArrow()
    drop(judged)
    coded = coded.sort_by([("id", "ascending"), ("codes", "ascending")]).to_pydict()
    weights = [np.frombuffer(w, np.int64) for w in coded["weights"]]
    sizes = [len(w) for w in weights]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.frombuffer(b"".join(coded["codes"]), np.uint8)
    y = np.array([np.nan if v is None else v for v in coded["y"]])
    return estimate(doc, codes.reshape(len(doc), -1) if len(doc) else np.zeros((0, len(BINS)), np.uint8), np.concatenate(weights) if weights else np.zeros(0, np.int64), y[doc] if len(doc) else np.zeros(0)), familiar


def not_prose(shares: DataFrame, model: LineModel, least_chars: int = 40) -> DataFrame:
    """The rows of `label_shares` of so many characters in which prose has less than the model's least share."""
    return shares.where((F.col("chars") >= least_chars) & (F.col("prose") < model.least))


def _labelled(spark: SparkSession, folder: str) -> tuple[DataFrame, LineModel]:
    docs = table(spark, folder, "documents")
    model, familiar = fit(docs, table(spark, folder, "text_labels"), "doc_id", "text", "is_prose")
    return label_shares(docs, "doc_id", "text", model, familiar), model


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of 40 characters or more that aren't running prose."""
    return not_prose(*_labelled(spark, folder)).select(F.col("id").alias("doc_id")).distinct()


def p10_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The plain statistics of every document."""
    stats = text_statistics(table(spark, folder, "documents"), "doc_id", "text")
    return stats.select(F.col("id").alias("doc_id"), *(F.round(c, 6).alias(c) for c in STATISTICS))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The shares of the line labels of every document."""
    shares, _ = _labelled(spark, folder)
    return shares.select(F.col("id").alias("doc_id"), *(F.round(c, 6).alias(c) for c in LABELS))


QUERIES = {"p10_found": p10_found, "p10_stats": p10_stats, "p10_labels": p10_labels}
_BLANKS = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]"
ORACLES = {
    "p10_stats": rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT doc_id, text, regexp_extract_all(text, '\p{{L}}[\p{{L}}\p{{M}}''’\-]*') AS w,
        list_filter(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: length(regexp_replace(x, '{_BLANKS}', '', 'g')) > 0) AS l, length(regexp_replace(text, '{_BLANKS}', '', 'g')) AS solid, length(regexp_replace(text, '[^\p{{Nd}}]', '', 'g')) AS digits FROM t),
        q AS (SELECT *, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS wc, len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in sorted(set(COMMON)))}))) AS c, len(list_filter(l, lambda x: regexp_matches(x, '[.!?…:]["''”’»«)\]]{{0,2}}{_BLANKS}*$'))) AS e FROM p)
        SELECT doc_id, CAST(len(w) AS DOUBLE) AS words, round(wc / greatest(len(w), 1), 6) AS mean_word, round((solid - wc - digits) / greatest(solid, 1), 6) AS symbol_ratio, round(e / greatest(len(l), 1), 6) AS end_share, round(c / greatest(len(w), 1), 6) AS common_share,
        CAST(len(l) AS DOUBLE) AS lines, CAST(length(regexp_replace(text, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')) AS DOUBLE) AS chars FROM q""",
}
