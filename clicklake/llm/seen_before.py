"""Whether each record's key occurred before, without holding the earlier keys as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.llm.elias_fano import SeenSet
from clicklake.sources.tables import table

_ROWS = "id bigint, stream boolean, keyed boolean, h bigint, part int, sure boolean"


def _repeats(parts: int, chunk_rows: int, width: int):
    """Within each chunk, records whose key an earlier record of the chunk has are surely repeats; they go anywhere."""

    def flag(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        ids, h = rows["id"].to_numpy(), rows["h"].to_numpy().view(np.uint64)
        stream, keyed = (rows[c].to_numpy(zero_copy_only=False) for c in ("stream", "keyed"))
        order = np.lexsort((ids, stream, h, ~keyed))
        same = np.zeros(len(ids), bool)
        a, b = order[:-1], order[1:]
        same[b] = keyed[b] & (h[b] == h[a])
        spread = ((ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)
        part = np.where(keyed & ~same, h % np.uint64(parts), spread).astype(np.int32)
        keep = stream | ~same
        out = [ids, stream, keyed, (h >> np.uint64(64 - width)).view(np.int64), part, same]
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in out], ["id", "stream", "keyed", "h", "part", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= chunk_rows:
                yield flag(held)
                held, size = [], 0
        if held:
            yield flag(held)

    return run


def _probe(width: int, chunk_rows: int):
    """Partitions come sorted by (part, earlier keys first, id); each part has its own set of the keys met so far."""

    def answer(seen: SeenSet, rows: pa.Table) -> pa.RecordBatch:
        keyed, sure, stream = (rows[c].to_numpy(zero_copy_only=False) for c in ("keyed", "sure", "stream"))
        asks = np.flatnonzero(keyed & ~sure)
        keys, first = np.unique(rows["h"].to_numpy()[asks].view(np.uint64), return_index=True)
        known = seen.contains(keys)
        seen.add(keys[~known])
        out = keyed.copy()
        out[asks[first[~known]]] = False
        return pa.RecordBatch.from_arrays([rows["id"].combine_chunks().filter(pa.array(stream)), pa.array(out[stream])], ["id", "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, current, held, size = SeenSet(width), None, [], 0
        for b in batches:
            part = b.column(b.schema.get_field_index("part")).to_numpy()
            edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(part)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if part[i] != current or size >= chunk_rows:
                    if held:
                        yield answer(seen, pa.Table.from_batches(held))
                    held, size = [], 0
                    if part[i] != current:
                        seen, current = SeenSet(width), part[i]
                held.append(b.slice(i, j - i))
                size += j - i
        if held:
            yield answer(seen, pa.Table.from_batches(held))

    return run


def seen_before(records: DataFrame, record_id: str, keys: list[str], earlier: DataFrame | None = None, width: int = 64, parts: int | None = None, chunk_rows: int = 1 << 17, keys_a_part: int = 1 << 22) -> DataFrame:
    """(id, seen) of every record: does its key occur in `earlier` (columns `keys`) or in a record with a smaller id?

    A record with a null in its key is never seen and never counts as earlier; ids are integers, in order of arrival; of
    records with equal ids, in whatever order, one at most is new. Keys are told apart by a 64-bit hash of which `width`
    bits are kept: an answer "seen" is wrong with a probability of about parts' keys / 2^width, an answer "new" never is
    (with the same hash for equal keys). A null id is treated as the smallest.

    Keys are spread by hash into `parts` (default: four a shuffle partition, or more, so that a part has about `keys_a_part`
    rows), each read in order of arrival and answered against an Elias-Fano set of what came before; a chunk's new keys are
    merged in, block by block, before the next is read. Memory is one chunk, a block, and one part's encoded keys. Records whose key an earlier record of the same input chunk has are answered there
    and spread at random, so a key that a third of all records share fills no part.
    """
    spark = records.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not parts:
        rows = records.count() + (earlier.count() if earlier is not None else 0)
        parts = max(4 * tasks, -(-rows // keys_a_part))
    keyed = lambda: F.forall(F.array(*(F.col(k).isNotNull() for k in keys)), lambda x: x)
    rows = records.select(F.coalesce(F.col(record_id).cast("long"), F.lit(-(2**63))).alias("id"), F.lit(True).alias("stream"), keyed().alias("keyed"), F.xxhash64(*keys).alias("h"))
    if earlier is not None:
        rows = rows.unionByName(earlier.where(keyed()).select(F.lit(0).cast("long").alias("id"), F.lit(False).alias("stream"), F.lit(True).alias("keyed"), F.xxhash64(*keys).alias("h")))
    rows = rows.mapInArrow(_repeats(parts, chunk_rows, width), _ROWS)
    rows = rows.repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part", "stream", "id")
    return rows.mapInArrow(_probe(width, chunk_rows), "id bigint, seen boolean")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "user_history").select("user_idx", F.explode("article_idx").alias("article_idx"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks whose user had clicked the article before, in the history or earlier in the stream."""
    found = seen_before(table(spark, folder, "clickstream"), "click_id", ["user_idx", "article_idx"], _history(spark, folder))
    return found.where("seen").select(F.col("id").alias("click_id"))


def p5_error_rate(spark: SparkSession, folder: str) -> DataFrame:
    """Of answers from 24-bit fingerprints, and from the 64-bit ones in use: how many are wrong, against the exact answer."""
    clicks, keys = table(spark, folder, "clickstream"), ["user_idx", "article_idx"]
    known = clicks.where("user_idx is not null and article_idx is not null")
    first = known.groupBy(*keys).agg(F.min("click_id").alias("first"))
    first = first.join(_history(spark, folder).distinct().withColumn("old", F.lit(True)), keys, "left")
    new = first.where("old is null").select(F.col("first").alias("id"), F.lit(True).alias("new"))
    out = None
    for width in (24, 64):
        got = seen_before(clicks, "click_id", keys, _history(spark, folder), width=width)
        got = got.join(clicks.select(F.col("click_id").alias("id"), F.expr("user_idx is not null and article_idx is not null").alias("keyed")), "id").join(new, "id", "left")
        wrong = F.col("seen") != (F.col("keyed") & F.col("new").isNull())
        got = got.agg(F.lit(width).alias("bits"), F.count("*").alias("answers"), F.count_if(wrong).alias("wrong"), F.round(F.count_if(wrong) / F.count("*"), 9).alias("rate"))
        out = got if out is None else out.unionByName(got)
    return out


QUERIES = {"p5_found": p5_found, "p5_error_rate": p5_error_rate}

ORACLES = {
    "p5_found": """
WITH h AS (SELECT DISTINCT user_idx, unnest(article_idx) AS article_idx FROM user_history),
c AS (SELECT *, min(click_id) OVER (PARTITION BY user_idx, article_idx) AS first FROM clickstream WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL)
SELECT click_id FROM c LEFT JOIN h ON h.user_idx = c.user_idx AND h.article_idx = c.article_idx WHERE click_id > first OR h.user_idx IS NOT NULL""",
}
