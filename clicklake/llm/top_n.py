"""Top N items of every group, by lower bounds that partitions find on their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.plans.cut import cut
from clicklake.sources.tables import table


def _local(n: int, chunk_rows: int):
    """Of each chunk of a partition: the rows among the N best of their group there; the N-th is a bound."""

    def best(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).group_by(["g", "item"]).aggregate([("score", "max")]).rename_columns(["g", "item", "score"])
        rows = rows.take(pc.sort_indices(rows, [("g", "ascending"), ("score", "descending"), ("item", "ascending")])).combine_chunks()
        g = rows["g"].combine_chunks()
        new = np.concatenate([[True], pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)])
        first = np.flatnonzero(new)
        rank = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
        rows = rows.append_column("bound", pa.array(rank == n - 1)).filter(pa.array(rank < n)).combine_chunks()
        return rows.to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.num_rows
            if size >= chunk_rows:
                yield best(held)
                held, size = [], 0
        if held:
            yield best(held)

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int = 10, chunk_rows: int = 1 << 18) -> DataFrame:
    """(group, item, score, rank): the n highest-scoring items of each group; equal scores go to the smaller item.

    An item counts once per group, with its highest score. Rows with a null group, null item or null or NaN score don't
    count; -0.0 equals 0.0; an empty table gives an empty result.

    Each partition ranks its own rows, in chunks of bounded size; its n-th (score, item) is a valid lower bound of the
    group's n-th best, so lower rows end there, which leaves at most n rows a chunk of even the largest group to shuffle.
    The best bound of each group is joined to the survivors, rows that rank under it are dropped, and the rest are ranked.
    The bound holds the item too, so where most scores are equal the ties under it are dropped like lower scores.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("item"), (F.col(score).cast("double") + F.lit(0.0)).alias("score")).where("g is not null and item is not null and score is not null and not isnan(score)")
    schema = "g {}, item {}, score double, bound boolean".format(*(dict(rows.dtypes)[c] for c in ("g", "item")))
    local = cut(rows.mapInArrow(_local(n, chunk_rows), schema), "topn")
    place = F.struct((-F.col("score")).alias("s"), "item")
    bounds = local.where("bound").groupBy("g").agg(F.min(place).alias("least"))
    left = local.join(bounds, "g", "left").where(F.col("least").isNull() | (place <= F.col("least")))
    left = left.groupBy("g", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("g").orderBy(F.desc("score"), "item"))
    return left.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias("group"), "item", "score", "rank")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten highest-scoring articles of each user."""
    found = top_n(table(spark, folder, "topk_scores"), "user_idx", "article_idx", "score", 10)
    return found.select(F.col("group").alias("user_idx"), F.col("item").alias("article_idx"))


def p3_ranked(spark: SparkSession, folder: str) -> DataFrame:
    """The same with score and rank."""
    found = top_n(table(spark, folder, "topk_scores"), "user_idx", "article_idx", "score", 10)
    return found.select(F.col("group").alias("user_idx"), F.col("item").alias("article_idx"), "score", "rank")


QUERIES = {"p3_found": p3_found, "p3_ranked": p3_ranked}

_RANKED = """
WITH best AS (SELECT user_idx, article_idx, max(score + 0.0) AS score FROM topk_scores WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_idx ORDER BY score DESC, article_idx) AS rank FROM best)
"""

ORACLES = {
    "p3_found": _RANKED + "SELECT user_idx, article_idx FROM r WHERE rank <= 10",
    "p3_ranked": _RANKED + "SELECT user_idx, article_idx, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10",
}
