"""Vector retrieval: normalising, pooling, exact and cell-probing search in blocks, quantising and projecting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.plans.cut import cut
from clicklake.sources.logs import ARTICLES, HISTORY, articles, histories, history_clicks, impressions, pair_table
from clicklake.sources.tables import table


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays zero. The length is bound once, outside the lambda over the elements."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(1e-12))), lambda n: F.transform(v, lambda x: x / n))[0]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pooled(rows: DataFrame, key: str, vector: str, weight: str | None = None) -> DataFrame:
    """(key, vector): the weighted mean of a group's vectors, at length 1; whole vectors are added before the shuffle and after."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    mean = Summarizer.mean(array_to_vector(F.col("v")), F.col("w"))
    whole = rows.where(F.col(vector).isNotNull()).select(key, w.alias("w"), F.col(vector).alias("v")).groupBy(key).agg(vector_to_array(mean).alias("vector"))
    return whole.select(key, unit(F.col("vector")).alias("vector"))


def user_vectors(history: DataFrame, vectors: DataFrame, halflife: float | None = None, normalise: bool = True) -> DataFrame:
    """(user_idx, vector): the mean of the vectors a user read, raw or at length 1 each, optionally halved every `halflife` places back."""
    rows = history_clicks(history)
    age = F.max("i").over(W.partitionBy("user_idx")) - F.col("i")
    rows = rows.withColumn("w", F.lit(1.0) if halflife is None else F.pow(F.lit(0.5), age / halflife))
    v = unit(F.col("vector")) if normalise else F.col("vector")
    return pooled(rows.join(vectors, "article_idx").select("user_idx", "w", v.alias("v")), "user_idx", "v", "w")


def _top(k: int, size: int):
    """Each row is a block of queries and a block of vectors: the k best vectors of each query there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, di, dv in zip(*(b.column(c).to_pylist() for c in range(4))):
                q, d = np.frombuffer(qv, np.float32).reshape(-1, size), np.frombuffer(dv, np.float32).reshape(-1, size)
                qid, did = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64)
                s = (q @ d.T).astype(np.float64)
                n = min(k, len(did))
                # what rounds to the edge's five decimals is kept; the global ranking settles such ties by id
                edge = -np.partition(-s, n - 1, axis=1)[:, n - 1 : n]
                i, j = np.nonzero(s >= edge - 1.1e-5)
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(did[j]), pa.array(s[i, j])], ["query", "item", "score"])

    return run


def _blocks(size: int, per: int, groups: int):
    """Rows of (id, vector, group) into blocks of at most `per` rows of one group: packed ids and float32 vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(g: int) -> pa.RecordBatch:
            ids, vs = zip(*held.pop(g))
            m = np.array(vs, np.float32).reshape(-1, size)
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
            return pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], ["cell", "ids", "vectors"])

        total = 0
        for b in batches:
            for i, v, g in zip(*(b.column(c).to_pylist() for c in range(3))):
                held.setdefault(g, []).append((i, v))
                total += 1
                if len(held[g]) >= per:
                    total -= len(held[g])
                    yield out(g)
            if total > 16 * per:
                for g in list(held):
                    yield out(g)
                total = 0
        for g in list(held):
            yield out(g)

    return run


def _ranked(met: DataFrame, k: int) -> DataFrame:
    best = met.groupBy("query", "item").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 5)), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _clean(df: DataFrame) -> DataFrame:
    return df.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<float>").alias("vector"))


def _met_blocks(queries: DataFrame, vectors: DataFrame, size: int, block: int, vectors_packed=None) -> DataFrame:
    """Each block of queries beside each block of vectors: (qi, qv, di, dv), packed ids and values.

    A block of vectors is copied to so many tasks as there are blocks of queries: the number of every query block, which one
    row holds, is opened beside it, and the pair is met by an equi-join on that number and a salt by block, so that neither
    the blocks of one query block nor those of one vector block fill a single task.
    """
    tasks = queries.sparkSession.sparkContext.defaultParallelism
    q = _clean(queries).withColumn("g", F.lit(0)).repartition(1 if queries.isEmpty() else tasks).mapInArrow(_blocks(size, block, 1), "cell int, ids binary, vectors binary")
    q = cut(q.select(F.monotonically_increasing_id().alias("qb"), F.col("ids").alias("qi"), F.col("vectors").alias("qv")), "queries")
    d = _clean(vectors).withColumn("g", F.lit(0)).repartition(tasks).mapInArrow(vectors_packed or _blocks(size, block, 1), "cell int, ids binary, vectors binary")
    numbers = q.agg(F.collect_list("qb").alias("all"))  # one number a query block
    salts = 8
    d = d.crossJoin(F.broadcast(numbers)).select(F.explode("all").alias("qb"), F.pmod(F.xxhash64("ids"), F.lit(salts)).alias("salt"), F.col("ids").alias("di"), F.col("vectors").alias("dv"))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return d.join(q, ["qb", "salt"]).select("qi", "qv", "di", "dv")


def knn_exact(queries: DataFrame, vectors: DataFrame, k: int = 10, size: int = 64, block: int = 2048) -> DataFrame:
    """(query, item, score, rank): the k vectors of greatest cosine for every query; equal ones, to five decimals, by id.

    `queries` and `vectors` have (id, vector). Both are packed into blocks of bounded size; one matrix product gives the best
    of a pair of blocks, and the bests are ranked. Null vectors and ids are left out.
    """
    return _ranked(_met_blocks(queries, vectors, size, block).mapInArrow(_top(k, size), "query bigint, item bigint, score double"), k)


def _rescored(near: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k best of (query, item) by exact cosine."""
    v = _clean(vectors).select(F.col("id").alias("item"), F.col("vector").alias("iv"))
    q = _clean(queries).select(F.col("id").alias("query"), F.col("vector").alias("qv"))
    met = near.select("query", "item").distinct().join(v, "item").join(q, "query")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = np.stack(a.to_list()).astype(np.float64), np.stack(b.to_list()).astype(np.float64)
        return pd.Series((x * y).sum(axis=1) / np.maximum(np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1), 1e-12))

    return _ranked(met.select("query", "item", cosine("iv", "qv").alias("score")), k)


def _best_of(k: int, approximate) -> Callable:
    """The `k` best of each query in a block, by approximate scores from packed codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, di, dv in zip(*(b.column(c).to_pylist() for c in range(4))):
                qid, did = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64)
                s = approximate(np.frombuffer(qv, np.float32).reshape(len(qid), -1), dv, len(did))
                n = min(k, len(did))
                j = np.argpartition(-s, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, n)), pa.array(did[j].reshape(-1)), pa.array(np.take_along_axis(s, j, 1).reshape(-1).astype(np.float64))], ["query", "item", "score"])

    return run


def _nearest(met: DataFrame, again: int) -> DataFrame:
    """The `again` best of each query over all blocks."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "item")
    return met.withColumn("r", F.row_number().over(w)).where(F.col("r") <= again)


def knn_int8(queries: DataFrame, vectors: DataFrame, k: int = 10, again: int = 40, size: int = 64, block: int = 4096) -> DataFrame:
    """The same by way of vectors scaled to 8-bit integers: a byte a dimension is moved and scanned, the `again` best are scored exactly."""
    pack = _blocks(size, block, 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pack(batches):
            out = []
            for v in b.column(2).to_pylist():
                x = np.frombuffer(v, np.float32).reshape(-1, size)
                top = np.maximum(np.abs(x).max(axis=1), 1e-12).astype(np.float32)
                out.append(top.tobytes() + np.round(x / top[:, None] * 127).astype(np.int8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["cell", "ids", "vectors"])

    def score(q: np.ndarray, codes: bytes, n: int) -> np.ndarray:
        top = np.frombuffer(codes, np.float32, n)
        return q @ np.frombuffer(codes, np.int8, offset=4 * n).reshape(n, size).astype(np.float32).T * top / 127

    met = _met_blocks(queries, vectors, size, block, packed).mapInArrow(_best_of(again, score), "query bigint, item bigint, score double")
    return _rescored(_nearest(met, again), queries, vectors, k)


def fit_codes(vectors: DataFrame, parts: int = 16, words: int = 64, sample: int = 20_000, rounds: int = 10, size: int = 64) -> np.ndarray:
    """(parts, words, size / parts): code words of each part of a unit vector, by k-means over at most `sample` vectors, those of the smallest hashes of their ids."""
    x = _sample(vectors, sample, size)
    wide, rng, out = size // parts, np.random.default_rng(7), np.zeros((parts, words, size // parts), np.float32)
    for j in range(parts if len(x) else 0):
        y = x[:, j * wide : (j + 1) * wide]
        c = y[rng.choice(len(y), words, replace=len(y) < words)].copy()
        for _ in range(rounds):
            near = _nearest_word(y, c)
            sums = np.stack([np.bincount(near, y[:, d], words) for d in range(wide)], axis=1)
            n = np.bincount(near, minlength=words)[:, None]
            c = np.where(n > 0, sums / np.maximum(n, 1), c).astype(np.float32)
        out[j] = c
    return out


def _nearest_word(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * y @ c.T).argmin(axis=1)


def knn_codes(queries: DataFrame, vectors: DataFrame, k: int = 10, again: int = 200, parts: int = 16, words: int = 64, size: int = 64, block: int = 16_384) -> DataFrame:
    """The same by way of product codes, a byte for each of `parts` parts of a vector; the `again` best are scored exactly.

    Every vector is coded; the code words come from a bounded sample (see fit_codes). A query's products with all words make
    a table, and a vector's score is the sum of the table's entries at its codes.
    """
    book, wide, pack = fit_codes(vectors, parts, words, size=size), size // parts, _blocks(size, block, 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pack(batches):
            out = []
            for v in b.column(2).to_pylist():
                x = np.frombuffer(v, np.float32).reshape(-1, size)
                out.append(np.column_stack([_nearest_word(x[:, j * wide : (j + 1) * wide], book[j]) for j in range(parts)]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["cell", "ids", "vectors"])

    def score(q: np.ndarray, codes: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(codes, np.uint8).reshape(n, parts)
        return sum((q[:, j * wide : (j + 1) * wide] @ book[j].T)[:, at[:, j]] for j in range(parts))

    met = _met_blocks(queries, vectors, size, block, packed).mapInArrow(_best_of(again, score), "query bigint, item bigint, score double")
    return _rescored(_nearest(met, again), queries, vectors, k)


def _graph(x: np.ndarray, links: int) -> np.ndarray:
    """(n, 2 x links): the nearest of each vector, half of them passed over if nearer to one taken before, and who has it so."""
    n = len(x)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    wide = min(n - 1, 4 * links)
    near = np.argsort(-s, axis=1)[:, :wide]
    out = np.repeat(np.arange(n)[:, None], 2 * links, axis=1)
    for i in range(n):
        taken: list[int] = []
        for j in near[i]:
            if len(taken) == links:
                break
            if all(s[j, t] < s[i, j] for t in taken):
                taken.append(int(j))
        taken += [int(j) for j in near[i] if j not in taken][: links - len(taken)]
        out[i, : len(taken)] = taken
    held = np.full(n, links)
    for i in range(n):
        for j in out[i, :links]:
            if held[j] < 2 * links and i not in out[j, : held[j]]:
                out[j, held[j]] = i
                held[j] += 1
    return out


def _walk(q: np.ndarray, x: np.ndarray, graph: np.ndarray, beam: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the `beam` best vectors met on walks over the graph, all queries a step at a time, with their scores."""
    rows = np.arange(len(q))[:, None]
    at = np.unique(np.linspace(0, len(x) - 1, min(beam, len(x))).astype(int))
    found = np.repeat(at[None, :], len(q), axis=0)
    score = q @ x[at].T
    seen = np.zeros((len(q), len(x)), bool)
    seen[:, at] = True
    opened = np.zeros(found.shape, bool)
    for _ in range(steps):
        open_score = np.where(opened, -np.inf, score)
        pick = np.argpartition(-open_score, min(3, found.shape[1] - 1), axis=1)[:, :4]
        if not np.isfinite(np.take_along_axis(open_score, pick, 1)).any():
            break
        fresh = np.isfinite(np.take_along_axis(open_score, pick, 1))
        opened[rows, pick] = True
        next_ = graph[found[rows, pick]]
        next_ = np.where(fresh[:, :, None], next_, found[rows, pick][:, :, None]).reshape(len(q), -1)
        new = ~seen[rows, next_]
        order = np.sort(next_, axis=1)
        first = np.zeros_like(new)
        idx = np.argsort(next_, axis=1, kind="stable")
        np.put_along_axis(first, idx, np.concatenate([np.ones((len(q), 1), bool), order[:, 1:] != order[:, :-1]], axis=1), 1)
        new &= first
        seen[rows, next_] = True
        s = np.where(new, np.einsum("qd,qnd->qn", q, x[next_]), -np.inf)
        every, scores, done = np.hstack([found, next_]), np.hstack([score, s]), np.hstack([opened, ~new])
        best = np.argpartition(-scores, beam - 1, axis=1)[:, :beam] if scores.shape[1] > beam else np.repeat(np.arange(scores.shape[1])[None], len(q), 0)
        found, score, opened = every[rows, best], scores[rows, best], done[rows, best]
    return found, score


def knn_graph(queries: DataFrame, vectors: DataFrame, k: int = 10, links: int = 12, beam: int = 64, steps: int = 40, size: int = 64, block: int = 2048) -> DataFrame:
    """The same by walks over navigable graphs, one a block of vectors: a node links to near ones in different directions."""
    pack = _blocks(size, block, 1)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pack(batches):
            out = [v + _graph(x, links).astype(np.int32).tobytes() for v in b.column(2).to_pylist() for x in [np.frombuffer(v, np.float32).reshape(-1, size)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["cell", "ids", "vectors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qi, qv, di, dv in zip(*(b.column(c).to_pylist() for c in range(4))):
                qid, did = np.frombuffer(qi, np.int64), np.frombuffer(di, np.int64)
                x, graph = np.frombuffer(dv, np.float32, len(did) * size).reshape(-1, size), np.frombuffer(dv, np.int32, offset=4 * len(did) * size).reshape(len(did), -1)
                for i in range(0, len(qid), 256):
                    found, score = _walk(np.frombuffer(qv, np.float32).reshape(-1, size)[i : i + 256], x, graph, max(beam, k), steps)
                    i_, j = np.nonzero(np.isfinite(score))
                    yield pa.RecordBatch.from_arrays([pa.array(qid[i : i + 256][i_]), pa.array(did[found[i_, j]]), pa.array(score[i_, j].astype(np.float64))], ["query", "item", "score"])

    return _ranked(_met_blocks(queries, vectors, size, block, packed).mapInArrow(run, "query bigint, item bigint, score double"), k)


def _sample(vectors: DataFrame, most: int, size: int) -> np.ndarray:
    """Unit vectors of at most `most` rows, those of the smallest hashes of their ids."""
    rows = vectors.where("id is not null and vector is not null").orderBy(F.xxhash64("id"), "id").limit(most).select("vector").toPandas()
    x = np.array(rows["vector"].tolist(), np.float32).reshape(-1, size)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_cells(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 12, size: int = 64) -> np.ndarray:
    """Centres of spherical k-means over at most `sample` vectors; about the square root of all vectors in number, unless given."""
    x = _sample(vectors, sample, size)
    cells = cells or max(1, round(vectors.count() ** 0.5))
    c = x[np.linspace(0, max(len(x) - 1, 0), min(cells, len(x))).astype(int)] if len(x) else np.zeros((1, size), np.float32)
    for _ in range(rounds if len(x) else 0):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(size)], axis=1)
        c = np.where(np.bincount(near, minlength=len(c))[:, None] > 0, sums, c).astype(np.float32)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _cells(centres: np.ndarray, probe: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.array(b.column(1).to_pylist(), np.float32).reshape(b.num_rows, -1)
                near = np.argsort(-(v @ centres.T), axis=1, kind="stable")[:, :probe].astype(np.int32)
                i = np.repeat(np.arange(b.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i)), pa.array(near.reshape(-1))], ["id", "vector", "cell"])

    return run


def knn_cells(queries: DataFrame, vectors: DataFrame, k: int = 10, cells: int | None = None, share: float = 0.75, probe: int | None = None, size: int = 64, block: int = 1024) -> DataFrame:
    """The same from the nearest cells of each query, this share of them or `probe`; every vector is indexed in the cell of its nearest centre.

    Centres come from a bounded sample (see fit_cells). A crowded cell is many blocks, so no task holds a whole cell. The
    default share suits vectors without clusters, where neighbours lie in any cell; clustered ones need far less.
    """
    centres = fit_cells(vectors, cells, size=size)
    probe = probe or max(1, round(share * len(centres)))
    schema = "id bigint, vector array<float>, cell int"
    q = _clean(queries).mapInArrow(_cells(centres, probe), schema).repartition("cell").mapInArrow(_blocks(size, block, len(centres)), "cell int, ids binary, vectors binary")
    d = _clean(vectors).mapInArrow(_cells(centres, 1), schema).mapInArrow(_blocks(size, block, len(centres)), "cell int, ids binary, vectors binary")
    met = q.toDF("cell", "qi", "qv").join(d.toDF("cell", "di", "dv"), "cell").select("qi", "qv", "di", "dv")
    return _ranked(met.mapInArrow(_top(k, size), "query bigint, item bigint, score double"), k)


def recall_by_score(got: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """One row: the share of the k places whose item is as good as the k-th exact one, less 1e-5."""
    edge = exact.groupBy("query").agg(F.min("score").alias("edge"), F.count("*").alias("places"))
    hits = edge.join(got, "query", "left").groupBy("query").agg(F.count_if(F.col("score") >= F.col("edge") - 1e-5).alias("hits"), F.max("places").alias("places"))
    return hits.agg((F.sum("hits") / F.sum("places")).alias("recall"), F.count("*").alias("queries"))


def quantised(v: Column, levels: int = 127) -> Column:
    """Integers of a vector scaled by its greatest absolute value."""
    top = F.greatest(F.array_max(F.transform(v, F.abs)), F.lit(1e-12))
    return F.transform(F.array(top), lambda t: F.transform(v, lambda x: F.round(x / t * levels).cast("int")))[0]


def projection(size: int, to: int, seed: int = 3) -> list[list[float]]:
    """A fixed Gaussian matrix of `to` rows, scaled so that inner products keep their mean."""
    return (np.random.default_rng(seed).normal(size=(to, size)) / np.sqrt(to)).tolist()


def projected(v: Column, matrix: list[list[float]]) -> Column:
    """The vector times the matrix, a product per Arrow batch; null for null."""
    m = np.array(matrix)

    @F.pandas_udf("array<double>")
    def times(vs: pd.Series) -> pd.Series:
        known = vs.notna().to_numpy()
        got = iter(np.stack(vs[known].to_list()) @ m.T if known.any() else ())
        return pd.Series([next(got) if k else None for k in known], dtype=object)

    return times(v)


# queries


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


def _article_vectors(spark, folder):
    return _vectors(spark, folder).withColumnRenamed("id", "article_idx")


def _queries(spark, folder):
    """The stated query set of searches: vectors whose id is divisible by 50."""
    return _vectors(spark, folder).where("id % 50 = 0")


def _texted(df: DataFrame, name: str = "vector", digits: int = 5) -> DataFrame:
    return df.withColumn(name, F.transform(name, lambda x: F.round(x, digits)))


def l2_normalise_q(spark, folder):
    v = unit(F.col("vector"))
    return _vectors(spark, folder).select("id", F.round(norm(v), 6).alias("length"), F.round(v[0], 6).alias("first"), F.round(F.array_max(v), 6).alias("greatest"))


def user_vectors_q(spark, folder):
    got = user_vectors(histories(spark, folder), _article_vectors(spark, folder))
    return got.select("user_idx", F.round(F.col("vector")[0], 5).alias("first"), F.round(F.col("vector")[63], 5).alias("last"), F.round(norm(F.col("vector")), 5).alias("length"))


def _searched(search):
    def query(spark, folder):
        return search(_queries(spark, folder), _vectors(spark, folder)).withColumn("score", F.round("score", 4))

    return query


def ann_recall_q(spark, folder):
    """Recall at ten of every kind of approximate search against the exact one, by score, with what a vector takes in bytes."""
    q, v = _queries(spark, folder), _vectors(spark, folder)
    exact, every = cut(knn_exact(q, v), "exact"), None
    kinds = (("cells, a quarter", 256, lambda: knn_cells(q, v, share=0.25)), ("cells, three quarters", 256, lambda: knn_cells(q, v)), ("8-bit integers", 64, lambda: knn_int8(q, v)), ("product codes", 16, lambda: knn_codes(q, v)), ("graph", 352, lambda: knn_graph(q, v)))
    for kind, size, search in kinds:
        one = recall_by_score(search(), exact).select(F.lit(kind).alias("kind"), F.lit(size).alias("bytes"), F.round("recall", 6).alias("recall"), "queries")
        every = one if every is None else every.unionByName(one)
    return every


def emb_cos_q(spark, folder):
    """Cosine of each shown article to the user's vector; 0 for unknown users and articles."""
    users = user_vectors(histories(spark, folder), _article_vectors(spark, folder)).withColumnRenamed("vector", "uv")
    shown = pair_table(impressions(spark, folder)).select("user_idx", "article_idx").where("user_idx is not null").distinct()
    met = shown.join(users, "user_idx", "left").join(_article_vectors(spark, folder), "article_idx", "left")
    return met.select("user_idx", "article_idx", F.round(F.coalesce(dot(F.col("uv"), unit(F.col("vector"))), F.lit(0.0)), 5).alias("cos"))


def best_read(shown: DataFrame, history: DataFrame, vectors: DataFrame, size: int = 64, block: int = 512) -> DataFrame:
    """(user_idx, article_idx, best): of each shown pair of known articles the greatest cosine to an article the user read.

    A user's reads are packed into matrices of at most `block` vectors beside which that user's shown articles are packed
    likewise; a product of two matrices gives all cosines of a pair of blocks, and only the best ones are shuffled on.
    """
    v = _clean(vectors.select(F.col("article_idx").alias("id"), "vector")).withColumnRenamed("id", "article_idx")
    read = history_clicks(history).select("user_idx", "article_idx").distinct().join(v, "article_idx")
    asked = shown.join(v, "article_idx").join(read.select("user_idx").distinct(), "user_idx", "left_semi")
    part = lambda df: df.withColumn("b", F.floor((F.row_number().over(W.partitionBy("user_idx").orderBy("article_idx")) - 1) / block))
    packed = lambda df, i, m: part(df).groupBy("user_idx", "b").agg(F.collect_list("article_idx").alias(i), F.flatten(F.collect_list("vector")).alias(m)).drop("b")
    met = packed(asked, "ids", "x").join(packed(read, "own", "y").drop("own"), "user_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x_at, y_at, i_at = (b.column(b.schema.get_field_index(c)) for c in ("x", "y", "ids"))
            users, ids, best = [], [], []
            for r, user in enumerate(b.column(0).to_pylist()):
                x, y = (c[r].values.to_numpy().astype(np.float64).reshape(-1, size) for c in (x_at, y_at))
                x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12) for m in (x, y))
                best.append((x @ y.T).max(axis=1))
                ids.append(i_at[r].values.to_numpy())
                users.append(np.full(len(x), user, np.int64))
            if users:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (users, ids, best)], ["user_idx", "article_idx", "best"])

    return met.mapInArrow(run, "user_idx bigint, article_idx bigint, best double").groupBy("user_idx", "article_idx").agg(F.max("best").alias("best"))


def emb_max_q(spark, folder):
    """The greatest cosine of each shown article to an article of the user's history."""
    shown = pair_table(impressions(spark, folder)).select("user_idx", "article_idx").where("user_idx is not null").distinct()
    return best_read(shown, histories(spark, folder), _article_vectors(spark, folder)).withColumn("best", F.round("best", 5))


def multi_interest_q(spark, folder):
    """Up to three queries a user, the mean of each third of the history; an article's score is the best of them."""
    rows = history_clicks(histories(spark, folder)).where("user_idx % 50 = 0").join(_article_vectors(spark, folder), "article_idx")
    rows = rows.withColumn("part", F.ntile(3).over(W.partitionBy("user_idx").orderBy("i")))
    parts = pooled(rows.select((F.col("user_idx") * 3 + F.col("part") - 1).alias("q"), unit(F.col("vector")).alias("v")), "q", "v")
    got = knn_exact(parts.select(F.col("q").alias("id"), "vector"), _vectors(spark, folder), 20)
    best = got.groupBy(F.floor(F.col("query") / 3).alias("user_idx"), "item").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("user_idx").orderBy(F.desc(F.round("score", 5)), "item"))).where("rank <= 10").withColumn("score", F.round("score", 4))


def threshold_cut_q(spark, folder):
    """Hits kept under a global threshold and under a share of each query's best; beside it the control, a fixed number of hits
    for every query that keeps as many in all as the threshold does."""
    got = cut(knn_exact(_queries(spark, folder), _vectors(spark, folder), 20), "hits")
    top = F.first("score").over(W.partitionBy("query").orderBy("rank"))
    rows = got.withColumn("relative", F.col("score") >= 0.8 * top)
    fixed = got.agg(F.round(F.count_if(F.col("score") >= 0.3) / F.count_distinct("query")).cast("int").alias("fixed"))
    return rows.crossJoin(F.broadcast(fixed)).groupBy("query").agg(F.count_if(F.col("score") >= 0.3).alias("over_tau"), F.count_if("relative").alias("over_share"), F.count_if(F.col("rank") <= F.col("fixed")).alias("fixed"))


def quantise_q(spark, folder):
    """Mean error of the length after rounding to 8 and to 4 bits."""
    v = F.col("vector")
    lost = lambda n: F.abs(norm(F.transform(quantised(v, n), lambda x: x.cast("double"))) / F.lit(float(n)) * F.array_max(F.transform(v, F.abs)) - norm(v)) / norm(v)
    return _vectors(spark, folder).where("vector is not null").agg(F.count("*").alias("n"), F.round(F.avg(lost(127)), 5).alias("error_8"), F.round(F.avg(lost(7)), 5).alias("error_4"))


def jl_projection_q(spark, folder):
    """Lengths and inner products after projecting 64 dimensions to 32, and the recall at ten of an exact search there."""
    matrix = projection(64, 32)
    units = cut(_vectors(spark, folder).where("vector is not null").select("id", unit(F.col("vector")).alias("u")).withColumn("p", projected(F.col("u"), matrix)), "projected")
    lengths = units.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(norm(F.col("p")) - norm(F.col("u")))), 6).alias("mean_error"), F.round(F.max(norm(F.col("p"))), 6).alias("greatest"))
    exact = cut(knn_exact(_queries(spark, folder), _vectors(spark, folder)), "exact")
    small = units.select("id", F.col("p").alias("vector"))
    near = knn_exact(small.where("id % 50 = 0"), small, 10, size=32)
    both = exact.join(near.select("query", "item", F.col("score").alias("small")), ["query", "item"], "left")
    found = both.agg(F.round(F.avg(F.col("small").isNotNull().cast("double")), 6).alias("recall"), F.round(F.avg(F.abs(F.col("score") - F.col("small"))), 6).alias("product_error"))
    return lengths.crossJoin(F.broadcast(found))


def align_embeddings_q(spark, folder):
    """A vector for every article, zeros where none is known, and whether it was."""
    got = articles(spark, folder).select(F.col("idx").alias("article_idx")).join(_article_vectors(spark, folder), "article_idx", "left")
    v = F.coalesce("vector", F.array_repeat(F.lit(0.0), 64))
    return got.select("article_idx", F.size(v).alias("n"), F.col("vector").isNotNull().alias("known"), F.round(norm(v), 5).alias("length"))


QUERIES = {
    "l2_normalise": l2_normalise_q, "user_vectors": user_vectors_q, "knn_exact": _searched(knn_exact), "knn_cells": _searched(knn_cells), "knn_int8": _searched(knn_int8), "knn_codes": _searched(knn_codes), "knn_graph": _searched(knn_graph), "ann_recall": ann_recall_q, "emb_cos": emb_cos_q, "emb_max": emb_max_q, "multi_interest": multi_interest_q,
    "threshold_cut": threshold_cut_q, "quantise": quantise_q, "jl_projection": jl_projection_q, "align_embeddings": align_embeddings_q,
}

_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings)"
_KNN = f"WITH {_V}, s AS (SELECT a.vec_id AS query, b.vec_id AS item, list_cosine_similarity(a.e, b.e) AS score FROM v a, v b WHERE a.vec_id % 50 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 5) DESC, item) AS rank FROM s)"
_UV = f"""{HISTORY}, {_V}, ho AS (SELECT user_idx, unnest(e) / n AS x, unnest(range(64)) AS d FROM hist_clicks JOIN v ON vec_id = article_idx), hm AS (SELECT user_idx, d, avg(x) AS x FROM ho GROUP BY 1, 2),
uv AS (SELECT user_idx, list(x ORDER BY d) AS u, sqrt(sum(x * x)) AS ul FROM hm GROUP BY 1)"""

ORACLES = {
    "l2_normalise": f"WITH {_V} SELECT vec_id AS id, CAST(n > 0 AS DOUBLE) AS length, round(e[1] / greatest(n, 1e-12), 6) AS first, round(list_max(e) / greatest(n, 1e-12), 6) AS greatest FROM v",
    "user_vectors": f"WITH {_UV} SELECT user_idx, round(u[1] / ul, 5) AS first, round(u[64] / ul, 5) AS last, CAST(1 AS DOUBLE) AS length FROM uv",
    "knn_exact": _KNN + " SELECT query, item, round(score, 4) AS score, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10",
    "threshold_cut": _KNN + ", t AS (SELECT *, first_value(score) OVER (PARTITION BY query ORDER BY rank) AS top FROM k WHERE rank <= 20) SELECT query, count(*) FILTER (score >= 0.3) AS over_tau, count(*) FILTER (score >= 0.8 * top) AS over_share, count(*) FILTER (rank <= (SELECT CAST(round(count(*) FILTER (score >= 0.3) / count(DISTINCT query)) AS INT) FROM t)) AS fixed FROM t GROUP BY 1",
    "quantise": f"WITH {_V}, t AS (SELECT e, n, list_max(list_transform(e, lambda x: abs(x))) AS top FROM v WHERE e IS NOT NULL), q AS (SELECT n, top, "
    + ", ".join(f"sqrt(list_sum(list_transform(e, lambda x: pow(round(x / greatest(top, 1e-12) * {m}), 2)))) / {m} * top AS l{m}" for m in (127, 7)) + " FROM t) SELECT count(*) AS n, round(avg(abs(l127 - n) / n), 5) AS error_8, round(avg(abs(l7 - n) / n), 5) AS error_4 FROM q",
    "emb_cos": f"WITH {_UV}, sh AS (SELECT DISTINCT user_idx, unnest(candidates) AS article_idx FROM impressions WHERE user_idx IS NOT NULL) SELECT sh.user_idx, sh.article_idx, round(coalesce(list_cosine_similarity(u, e), 0), 5) AS cos FROM sh LEFT JOIN uv ON uv.user_idx = sh.user_idx LEFT JOIN v ON vec_id = sh.article_idx",
    "emb_max": f"""WITH {HISTORY}, {_V}, sh AS (SELECT DISTINCT user_idx, unnest(candidates) AS article_idx FROM impressions WHERE user_idx IS NOT NULL), rd AS (SELECT DISTINCT user_idx, article_idx FROM hist_clicks)
        SELECT sh.user_idx, sh.article_idx, round(max(list_cosine_similarity(a.e, b.e)), 5) AS best FROM sh JOIN v a ON a.vec_id = sh.article_idx JOIN rd ON rd.user_idx = sh.user_idx JOIN v b ON b.vec_id = rd.article_idx GROUP BY 1, 2""",
    "align_embeddings": f"WITH {ARTICLES}, {_V} SELECT idx AS article_idx, CAST(64 AS INT) AS n, vec_id IS NOT NULL AS known, round(coalesce(n, 0), 5) AS length FROM art LEFT JOIN v ON vec_id = idx",
}
