"""Token ids of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.llm.bpe import encoder, tokenizer_path
from clicklake.plans.cut import spread
from clicklake.sources.tables import table


def _encode(path: str, only_count: bool, step: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, step):
                part = b.slice(i, step)
                sizes, flat = [0], []
                for text in part.column(1).to_pylist():
                    ids = code.encode(text) if text else []
                    sizes.append(len(ids))
                    if not only_count:
                        flat.append(np.array(ids, np.int32))
                if only_count:
                    out = pa.array(sizes[1:], pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), out], ["id", "n" if only_count else "ids"])

    return run


def _rows(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return spread(rows), dict(rows.dtypes)["id"]


def token_ids(docs: DataFrame, doc_id: str, text: str, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, ids) of every row: the ids of its text, none for a null or empty one; repeated rows come out as often.

    No special tokens: their strings are ordinary text. Each row is encoded where it lies, without a shuffle (tables of
    fewer partitions than cores are dealt out first). Workers remember a bounded number of short pieces; a piece of n bytes
    costs n log n. The rank file must be at the same place on every executor.
    """
    rows, kind = _rows(docs, doc_id, text)
    return rows.mapInArrow(_encode(tokenizer_path(tokenizer, folder), False), f"id {kind}, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str, text: str, tokenizer: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id, n) of every row: how many ids its text has."""
    rows, kind = _rows(docs, doc_id, text)
    return rows.mapInArrow(_encode(tokenizer_path(tokenizer, folder), True), f"id {kind}, n bigint")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document."""
    return token_ids(table(spark, folder, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "ids")


QUERIES = {"p8_ids": p8_ids}
ORACLES: dict[str, str] = {}
