"""Filling containers of fixed capacity with whole items: hierarchical packing over several lengths.

Sizes are integers up to the capacity, so their histogram has at most `capacity` rows however large the corpus is. The plan
is made over the histogram on the driver. Items are routed to tiers of context sizes (2048, 512, 128 tokens), the shortest
that holds them. From the longest tier down, a tier's items are packed into windows of its own context, and the gaps these
leave are filled from the shorter tiers; what a shorter tier keeps is packed the same way. Windows of the longest tier are
containers; those of shorter tiers are then joined, whole, in what containers have left and in new ones.

The plan is two lists of ranges: "items number a to b of size s go to windows w, w+1, ... of a tier at offset o", and
"windows number a to b of a tier go to containers c, c+1, ... at offset o". Executors number the items of each size and
look both ranges up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.llm.tokens import token_counts
from clicklake.plans.cut import cut
from clicklake.sources.tables import table


@dataclass(frozen=True)
class Run:
    """`count` windows from `start` on that hold the same sizes: what is left in each, and the squares of its sizes."""

    start: int
    count: int
    left: int
    cost: int


class Windows:
    """Windows of one context size, as runs of equally filled ones, with the tightest gap for a size at hand."""

    def __init__(self, context: int):
        self.context, self.made = context, 0
        self._gaps: dict[int, list[Run]] = defaultdict(list)
        self._lefts: list[int] = []

    def _put(self, run: Run) -> None:
        if not self._gaps[run.left]:
            insort(self._lefts, run.left)
        self._gaps[run.left].append(run)

    def fill(self, size: int, cost: int, n: int, told: Callable[[int, int, int], None]) -> int:
        """Put up to n pieces of one size and cost into the tightest gaps; the number left over. `told` hears (window, offset, pieces)."""
        while n and (i := bisect_left(self._lefts, size)) < len(self._lefts):
            left = self._lefts[i]
            run = self._gaps[left].pop()
            if not self._gaps[left]:
                self._lefts.pop(i)
            m = min(n, run.count)
            told(run.start, self.context - left, m)
            self._put(Run(run.start, m, left - size, run.cost + cost))
            if m < run.count:
                self._put(Run(run.start + m, run.count - m, left, run.cost))
            n -= m
        return n

    def place(self, size: int, cost: int, n: int, told: Callable[[int, int, int], None]) -> None:
        """Put n pieces of one size and cost into gaps, and into new windows where none is left."""
        while n := self.fill(size, cost, n, told):
            opened = -(-n // (self.context // size))
            self._put(Run(self.made, opened, self.context, 0))
            self.made += opened

    def runs(self) -> list[Run]:
        return [r for rs in self._gaps.values() for r in rs]


@dataclass
class Plan:
    """Sorted ranges of items (size, first rank, tier, first window, offset), for each tier but the longest sorted ranges of
    its windows (first window, first container, offset), and the containers as runs."""

    ranges: list[tuple[int, int, int, int, int]]
    joins: list[list[tuple[int, int, int]]]
    runs: list[Run]
    containers: int


def tiers_of(capacity: int, factor: int = 4, least: int = 128) -> list[int]:
    """Context sizes of the tiers, longest first: each the one before divided by the factor, down to `least`."""
    out = [capacity]
    while out[-1] // factor >= least:
        out.append(out[-1] // factor)
    return out


def make_plan(histogram: Mapping[int, int], capacity: int, tiers: list[int] | None = None) -> Plan:
    """Containers for so many items of each size, all sizes between 1 and the capacity, by way of these tiers."""
    tiers = tiers or tiers_of(capacity)
    ranges: list[tuple[int, int, int, int, int]] = []
    rest, rank = dict(histogram), dict.fromkeys(histogram, 0)
    packed: list[Windows] = []
    for t, (context, low) in enumerate(zip(tiers, [*tiers[1:], 0])):
        w = Windows(context)
        for size in sorted((s for s in rest if s <= context), reverse=True):

            def told(window: int, offset: int, m: int, size=size, t=t) -> None:
                ranges.append((size, rank[size], t, window, offset))
                rank[size] += m

            if size > low:
                w.place(size, size * size, rest.pop(size), told)
            else:
                rest[size] = w.fill(size, size * size, rest[size], told)
                if not rest[size]:
                    del rest[size]
        packed.append(w)
    containers, joins = packed[0], []
    for w in packed[1:]:
        own: list[tuple[int, int, int]] = []
        for run in sorted(w.runs(), key=lambda r: (r.left, r.start)):
            at = run.start

            def joined(container: int, offset: int, m: int) -> None:
                nonlocal at
                own.append((at, container, offset))
                at += m

            containers.place(w.context - run.left, run.cost, run.count, joined)
        joins.append(sorted(own))
    return Plan(sorted(ranges), joins, containers.runs(), containers.made)


def step_groups(plan: Plan, whole: int, capacity: int) -> list[tuple[int, int, int]]:
    """(first container, place in the order of cost, tokens) of each run, dearest first; `whole` full ones follow the plan's.

    Dealing the places to and fro over the steps gives each step as many dear containers as cheap ones.
    """
    runs = [*plan.runs, *([Run(plan.containers, whole, 0, capacity * capacity)] if whole else [])]
    out, place = [], 0
    for r in sorted(runs, key=lambda r: (-r.cost, r.start)):
        out.append((r.start, place, capacity - r.left))
        place += r.count
    return sorted(out)


def step_of(place: np.ndarray, containers: int, per_step: int) -> np.ndarray:
    """The step of a container by its place in the order of cost."""
    steps = max(1, -(-containers // per_step))
    row, column = place // steps, place % steps
    return np.where(row % 2 == 0, column, steps - 1 - column)


def _assign(plan: Plan, tiers: list[int], whole: int, capacity: int, per_step: int):
    shift = 44  # ranks under 2^44, sizes under 2^19
    starts = np.array([s << shift | r for s, r, *_ in plan.ranges], np.int64)
    first = np.array([x[1:] for x in plan.ranges], np.int64).reshape(-1, 4)
    joins = [np.array(x, np.int64).reshape(-1, 3) for x in plan.joins]
    order = np.array(step_groups(plan, whole, capacity), np.int64).reshape(-1, 3)
    contexts = np.array(tiers[::-1])
    total = plan.containers + whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, piece, n, rank = b.column(0), b.column(1), b.column(2).to_numpy(), b.column(3).to_numpy()
            full = n == capacity
            container, offset, window = plan.containers + rank, np.zeros(len(n), np.int64), np.full(len(n), capacity)
            if len(starts):
                r = first[np.searchsorted(starts, n << shift | rank, side="right") - 1]
                container = np.where(full, container, r[:, 2] + rank - r[:, 0])
                offset = np.where(full, 0, r[:, 3])
                for t, own in enumerate(joins, 1):
                    of = np.flatnonzero(~full & (r[:, 1] == t))
                    j = own[np.searchsorted(own[:, 0], container[of], side="right") - 1]
                    container[of] += j[:, 1] - j[:, 0]
                    offset[of] += j[:, 2]
                    window[of] = tiers[t]
            at = np.searchsorted(order[:, 0], container, side="right") - 1
            step = step_of(order[at, 1] + container - order[at, 0], total, per_step)
            tier = contexts[np.searchsorted(contexts, n)]
            yield pa.RecordBatch.from_arrays([ids, piece, *(pa.array(x.astype(np.int64)) for x in (n, container, offset, tier, window, step))], ["id", "piece", "tokens", "container", "offset", "tier", "window", "step"])

    return run


def pack_items(sizes: DataFrame, capacity: int = 2048, per_step: int = 64, buckets: int = 64, tiers: list[int] | None = None) -> DataFrame:
    """(id, piece, tokens, container, offset, tier, window, step): where each item, or each piece of one above the capacity, lies.

    `tier` is the context an item was routed to, `window` that of the window it was packed into: a longer one where it fills a gap.

    `sizes` has (id, n), one row an item. Items of null or no size get no row. An item over the capacity is cut into full
    pieces and a rest, others stay whole. `step` groups about `per_step` containers so that the sums of squared lengths,
    the cost of attention, are alike. Rows of a repeated id are items of their own.

    To the driver come the histogram (at most `capacity` rows) and one sum. Items of a size are numbered within buckets of
    their id's hash, shifted by the counts of the buckets before: at most capacity x buckets rows are summed up, and the
    commonest size is numbered by as many tasks as there are buckets.
    """
    if not 1 <= capacity < 1 << 19:
        raise ValueError("a capacity is between 1 and 2^19 - 1")
    sizes = sizes.select("id", F.col("n").cast("long").alias("n")).where("n > 0").withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
    pieces = sizes.select("id", "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / capacity))).alias("piece"), "n")
    pieces = pieces.select("id", "bucket", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("n"))
    counts = cut(pieces.groupBy("n", "bucket").agg(F.count("*").alias("k")), "histogram")
    histogram = {r[0]: r[1] for r in counts.groupBy("n").agg(F.sum("k")).collect()}
    whole = histogram.pop(capacity, 0)
    tiers = tiers or tiers_of(capacity)
    plan = make_plan(histogram, capacity, tiers)
    before = F.sum("k").over(W.partitionBy("n").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    shifts = counts.select("n", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("n", "bucket").orderBy("id", "piece")) - 1
    ranked = pieces.withColumn("in_bucket", rank).join(shifts, ["n", "bucket"]).select("id", "piece", "n", (F.col("in_bucket") + F.col("before")).alias("rank"))
    kind = dict(ranked.dtypes)["id"]
    return ranked.mapInArrow(_assign(plan, tiers, whole, capacity, per_step), f"id {kind}, piece bigint, tokens bigint, container bigint, offset bigint, tier bigint, window bigint, step bigint")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack_items(cut(token_counts(table(spark, folder, "documents"), "doc_id", "text"), "sizes"))


def p9_packed(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of every piece of a long one."""
    return _packed(spark, folder).withColumnRenamed("id", "doc_id")


def p9_waste(spark: SparkSession, folder: str) -> DataFrame:
    """For each longest window that containers hold: containers, tokens, the share of capacity left unused; and over all of them the least and greatest cost of a step."""
    packed = cut(_packed(spark, folder), "packed")
    held = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.max("window").alias("window"))
    steps = packed.groupBy("step").agg(F.sum(F.col("tokens") * F.col("tokens")).alias("cost")).agg(F.min("cost").alias("least_cost"), F.max("cost").alias("greatest_cost"))
    return held.groupBy("window").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.round(1 - F.sum("tokens") / (F.count("*") * 2048), 9).alias("unused")).crossJoin(F.broadcast(steps))


def p9_checks(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents that have a container, containers above the capacity, such with a hole or an overlap, and documents that fit but were cut."""
    packed = cut(_packed(spark, folder), "packed")
    of_container = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.count("*").alias("n"), F.count_distinct("offset").alias("offsets"))
    bad = of_container.agg(F.count_if(F.col("tokens") > 2048).alias("over"), F.count_if((F.col("tokens") != F.col("end")) | (F.col("n") != F.col("offsets"))).alias("torn"))
    docs = packed.groupBy("id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")).agg(F.count("*").alias("documents"), F.count_if((F.col("tokens") <= 2048) & (F.col("pieces") > 1)).alias("cut"))
    return docs.crossJoin(F.broadcast(bad))


QUERIES = {"p9_packed": p9_packed, "p9_waste": p9_waste, "p9_checks": p9_checks}
ORACLES = {"p9_checks": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS cut, 0::BIGINT AS over, 0::BIGINT AS torn FROM documents WHERE length(text) > 0"}
