"""Operators that split hot groups or prune, against plain ones; streams of several deliveries; tables of a scope."""

import random
import types

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.functions.stems import danish
from clicklake.operators.candidates import random_topk, ranked_in_slices, rrf
from clicklake.operators.lexical import search, search_pruned
from clicklake.operators.lists import list_rank, remap_list
from clicklake.operators.postings import skip_steps
from clicklake.operators.vectors import best_read, knn_cells, knn_codes, knn_exact, knn_graph, knn_int8, recall_by_score
from clicklake.operators.windows import asof_before_all, running
from clicklake.plans import cut as cuts
from clicklake.streaming.counters import deduplicated, replayed, rolling_counters, windowed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_running_sums_over_buckets_equal_one_window(spark):
    rng = random.Random(1)
    data = {(k, t): (k, t, rng.randint(0, 9), rng.random()) for k in (1, 1, 1, 2) for t in rng.sample(range(0, 40 * 86400), 200)}
    df = spark.createDataFrame(list(data.values()), "k long, s long, a long, b double").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"), "a", "b")
    for strict in (True, False):
        w = W.partitionBy("k").orderBy("t").rowsBetween(W.unboundedPreceding, -1 if strict else 0)
        want = df.select("k", "t", F.coalesce(F.sum("a").over(w), F.lit(0)).alias("a"), F.round(F.coalesce(F.sum("b").over(w), F.lit(0.0)), 9).alias("b"))
        got = running(df, "k", "t", ("a", "b"), strict).withColumn("b", F.round("b", 9))
        assert rows(got) == rows(want) and got.count() == len(data)


def test_asof_of_two_tables(spark):
    rng = random.Random(2)
    at = lambda df: df.withColumn("t", F.timestamp_seconds("t").cast("timestamp_ntz"))
    left = [(i, rng.choice([1, 2, None]), rng.choice([None, *range(0, 400000, 7000)])) for i in range(300)]
    right = [{(k, t): rng.random() for k in (1, 2) for t in rng.sample(range(0, 400000, 7000), 20)} for _ in range(2)]
    frames = [at(spark.createDataFrame([(k, t, v) for (k, t), v in r.items()], f"k long, t long, v{i} double")) for i, r in enumerate(right)]
    got = asof_before_all(at(spark.createDataFrame(left, "i long, k long, t long")), [(f, [f"v{i}"]) for i, f in enumerate(frames)], "k", "t").select("i", "v0", "v1")
    last = lambda r, k, t: max(((u, v) for (q, u), v in r.items() if q == k and t is not None and u < t), default=(0, None))[1]
    assert rows(got) == [(i, *(last(r, k, t) for r in right)) for i, k, t in left]


def test_slices_rank_like_one_sort(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 1, 1, 2]), i, rng.choice([0.5, 0.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(data, "g long, i long, s double")
    want = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy(F.desc("s"), "i")))
    assert rows(ranked_in_slices(df, ("g",), "s", "i", "r", 16).select("g", "i", "r")) == rows(want.select("g", "i", "r"))
    assert rrf(df.select(F.col("g").alias("user_idx"), F.col("i").alias("article_idx"), F.lit("x").alias("src"), F.col("s").alias("score")).limit(0), "src", None).count() == 0


@pytest.mark.parametrize("size", [0, 3, 5, 6, 39, 200])
def test_random_lists_are_full(spark, size):
    universe = spark.range(size).select((F.col("id") * 3).alias("idx"))
    got = random_topk(spark.range(300).select(F.col("id").alias("user_idx")), universe, 5).groupBy("user_idx").agg(F.count_distinct("article_idx").alias("n"), F.max("rank").alias("r")).collect()
    assert {(r["n"], r["r"]) for r in got} == ({(min(5, size),) * 2} if size else set())


def test_a_heavy_reader_still_gets_a_list(spark):
    from clicklake.operators.candidates import drop_seen, top_rows

    lists = spark.range(1100).select(F.lit(1).cast("long").alias("user_idx"), F.col("id").alias("article_idx"), F.lit("a").alias("src"), (-F.col("id")).cast("double").alias("score"))
    seen = spark.range(1000).select(F.lit(1).cast("long").alias("user_idx"), F.col("id").alias("article_idx"))
    got = top_rows(drop_seen(rrf(lists, "src", None), seen), 50, F.desc("score"), F.col("article_idx"))
    assert [r["article_idx"] for r in got.orderBy("rank").collect()] == list(range(1000, 1050))


def test_lists_map_the_same_in_place_and_by_join(spark):
    data = [(1, [5, 7, 5, 9]), (2, []), (3, None), (4, [9, None, 8]), (5, [100])]
    df = spark.createDataFrame(data, "r long, l array<long>").withColumn("mapped", F.lit("clash"))
    ids = spark.createDataFrame([(5, 50), (7, 70), (9, 90), (None, 1)], "key long, id long")
    want = [(1, [50, 70, 50, 90]), (2, []), (3, []), (4, [90]), (5, [])]
    assert [rows(remap_list(df, "r", "l", ids, most)) for most in (10, 1)] == [want, want]
    assert rows(remap_list(df, "r", "l", ids.limit(0)))[0] == (1, [])
    assert df.limit(1).select(list_rank(F.array(*map(F.lit, (0.5, 2.0, 0.5, 2.0, 1.0)))).alias("r")).first()[0] == [4, 1, 5, 2, 3]


def test_pruned_search_is_rank_safe(spark):
    rng = random.Random(4)
    weights = [(d, f"t{t}", round(rng.random() * (3 if t > 30 else 0.3), 6)) for d in range(600) for t in {min(39, int(rng.expovariate(0.1))) for _ in range(6)}]
    queries = [(u, f"t{t}", float(rng.randint(1, 3))) for u in range(12) for t in rng.sample(range(40), rng.choice([1, 4, 8]))]
    w = spark.createDataFrame(weights, "doc_id long, term string, w double")
    q = spark.createDataFrame(queries, "user_idx long, term string, q double")
    for span in (16, 100, 1000):
        assert rows(search_pruned(q, w, 5, span)) == rows(search(q, w, 5))


def test_skips_find_the_same_in_fewer_steps():
    rng = np.random.default_rng(5)
    for n, m in ((0, 5), (3, 3000), (500, 500)):
        a, b = (np.unique(rng.integers(0, 9000, k)) for k in (n, m))
        both, plain, steps = skip_steps(a, b)
        assert both == len(np.intersect1d(a, b)) and (steps <= plain or n == m or n == 0)
    assert skip_steps(np.arange(5), np.arange(5))[0] == 5


def test_danish_stems():
    got = {w: danish(w) for w in "undersøgelserne hestene lykkeligst friheden arbejdsløst indtægt husets kommer bus s".split()}
    assert got == {"undersøgelserne": "undersøg", "hestene": "hest", "lykkeligst": "lyk", "friheden": "frihed", "arbejdsløst": "arbejdsløs", "indtægt": "indtæg", "husets": "hus", "kommer": "kom", "bus": "bus", "s": "s"}


def test_approximate_searches_recall_most(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(700, 64)).astype(np.float32)
    x[5] = x[6]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(900, None)], "id long, vector array<float>")
    q = v.where("id % 20 = 0")
    exact = knn_exact(q, v, 10, block=100).cache()
    best = np.argsort(-(x[::20] @ x.T) / np.linalg.norm(x, axis=1), axis=1)[:, :10]
    got = {r["query"]: [] for r in exact.collect()}
    for r in exact.orderBy("rank").collect():
        got[r["query"]].append(r["item"])
    assert sum(len(set(got[20 * i]) & set(b)) for i, b in enumerate(best)) >= 348
    for search, least in ((lambda: knn_int8(q, v, block=128), 0.99), (lambda: knn_codes(q, v, block=128), 0.95), (lambda: knn_graph(q, v, block=256), 0.9), (lambda: knn_cells(q, v), 0.9)):
        assert recall_by_score(search(), exact).first()["recall"] >= least
    assert knn_int8(q.limit(0), v).count() == 0


def test_best_read_in_blocks(spark):
    rng = np.random.default_rng(7)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(40)], "article_idx long, vector array<double>")
    shown = spark.createDataFrame([(u, a) for u in (1, 2, 3) for a in range(0, 50, 3)], "user_idx long, article_idx long")
    history = spark.createDataFrame([(1, list(range(30)), None), (2, [3, 99], None)], "user_idx long, article_idx array<long>, ts array<timestamp_ntz>")
    x = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in v.collect()}
    want = [(u, a, round(max(float(x[a] @ x[h]) for h in own if h in x), 6)) for u, own in ((1, range(30)), (2, [3, 99])) for a in range(0, 50, 3) if a in x]
    for block in (4, 512):
        assert rows(best_read(shown, history, v, 8, block).withColumn("best", F.round("best", 6))) == sorted(want)


def test_streams_of_several_deliveries(spark):
    base = "timestamp_ntz'2024-01-01 00:00:00'"
    data = [(i, i % 2, 3600 * i, i % 3 == 0) for i in range(100)] + [(100, 0, 60, True), (101, 1, 3600 * 99, True)]
    df = spark.createDataFrame(data, "n long, article_idx long, s long, label boolean").select("n", "article_idx", (F.expr(base) + F.make_dt_interval(secs=F.col("s"))).alias("time"), "label")
    days = rows(replayed(df, "n", lambda s: windowed(s, "time", "article_idx", "1 day", late="2 hours"), 5).select("article_idx", "n"))
    # row 100 is late; the last day is still open
    assert days == [(0, 12)] * 4 + [(1, 12)] * 4
    counted = replayed(df, "n", rolling_counters, 5).groupBy("article_idx").agg(F.max("roll_inview"), F.max("roll_clicks"), F.sum("late"))
    assert rows(counted) == [(0, 50, 17, 1), (1, 51, 18, 0)]
    twice = df.unionByName(df.where("n < 40"))
    assert replayed(twice, "n", lambda s: deduplicated(s, "n", "time", "2 hours"), 4).count() == 101
    assert replayed(df.limit(0), "n", rolling_counters, 2).count() == 0


def test_a_scope_leaves_no_table(spark):
    before = len(cuts._written)
    with cuts.scoped():
        t = cuts.cut(spark.range(5), "scoped")
        path = t._clicklake_path
        assert t.count() == 5
    assert len(cuts._written) == before
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_a_cluster_must_name_its_folder():
    fake = types.SimpleNamespace(sparkContext=types.SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cuts.shared_dir(fake)


@pytest.mark.parametrize("find", [lambda q, w: search_pruned(q, w, 5, 16), lambda q, w: search(q, w, 5)])
def test_searches_in_blocks_make_no_rows_of_touched_postings(spark, monkeypatch, find):
    from clicklake.operators import lexical

    monkeypatch.setattr(lexical, "QUERY_ROWS", 30)
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    rng = random.Random(6)
    weights = {(d, f"t{min(29, int(rng.expovariate(0.15)))}"): rng.choice([0.5, rng.random()]) for d in range(700) for _ in range(4)}  # equal scores too
    queries = {(u, f"t{t}"): float(rng.randint(1, 2)) for u in range(20) for t in rng.sample(range(32), rng.choice([1, 3, 9]))}
    scores = {}
    for (u, t), q in queries.items():
        for (d, own), w in weights.items():
            if own == t:
                scores[u, d] = scores.get((u, d), 0) + q * w
    want = [(u, d, round(s, 6), r + 1) for u in range(20) for r, (s, d) in enumerate(sorted(((round(s, 9), d) for (v, d), s in scores.items() if v == u), key=lambda x: (-x[0], x[1]))[:5])]
    q, w = spark.createDataFrame([(*k, v) for k, v in queries.items()], "user_idx long, term string, q double"), spark.createDataFrame([(*k, v) for k, v in weights.items()], "doc_id long, term string, w double")
    got = find(q, w)
    assert rows(got.withColumn("score", F.round("score", 6)).select("user_idx", "doc_id", "score", "rank")) == sorted(want)
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()  # blocks, not postings, meet


def _small_index(spark):
    rng = random.Random(7)
    lists = {(d, f"t{min(29, int(rng.expovariate(0.15)))}"): rng.random() for d in range(500) for _ in range(4)}
    asked = {(u, f"t{t}"): float(rng.randint(1, 2)) for u in range(20) for t in rng.sample(range(32), rng.choice([1, 3, 9]))}
    return lists, asked, spark.createDataFrame([(*k, v) for k, v in asked.items()], "user_idx long, term string, q double"), spark.createDataFrame([(*k, v) for k, v in lists.items()], "doc_id long, term string, w double")


def test_work_of_a_traversal_is_counted_in_blocks(spark, monkeypatch):
    from clicklake.operators import postings

    monkeypatch.setattr(postings, "QUERY_ROWS", 30)
    monkeypatch.setattr(postings, "POSTINGS", 300)
    lists, asked, q, w = _small_index(spark)
    want = {u: ([t for v, t in asked if v == u and any(t == own for _, own in lists)], [d for d, t in lists if (u, t) in asked]) for u in range(20)}
    got = postings.traversal_work(q, w, w.groupBy("term").agg(F.count("*").alias("df")))
    assert rows(got) == [(u, len(terms), len(docs), len(set(docs))) for u, (terms, docs) in want.items() if docs]
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()  # blocks, not postings, meet


def test_spans_are_counted_in_blocks(spark, monkeypatch):
    from clicklake.operators import lexical

    monkeypatch.setattr(lexical, "QUERY_ROWS", 30)
    monkeypatch.setattr(lexical, "POSTINGS", 300)
    lists, asked, q, w = _small_index(spark)
    want = {u: np.zeros(4, int) for u in range(20)}
    for u in want:
        scores, bounds, n = {}, {}, {}
        for (d, t), x in lists.items():
            if (u, t) in asked:
                scores[d] = scores.get(d, 0) + asked[u, t] * x
                bounds[d // 8, t] = max(bounds.get((d // 8, t), 0), asked[u, t] * x)
                n[d // 8] = n.get(d // 8, 0) + 1
        edge = sorted(scores.values())[-5] if len(scores) >= 5 else 0  # every term of a query is a seed
        opened = [s for s in n if sum(x for (own, _), x in bounds.items() if own == s) >= edge - 1e-6]
        want[u] += [sum(n.values()), sum(n[s] for s in opened), len(n), len(opened)]
    got = lexical.span_work(q, w, 5, 8).groupBy("user_idx").agg(*(F.sum(c).alias(c) for c in ("touched", "opened", "spans", "open_spans")))
    assert rows(got) == [(u, *x.tolist()) for u, x in want.items() if x[0]]
    assert "CartesianProduct" in got._jdf.queryExecution().executedPlan().toString()  # blocks, not postings, meet


def test_spans_of_all_sets_and_ends_are_counted_in_two_meetings(spark, monkeypatch):
    from clicklake.operators import lexical

    monkeypatch.setattr(lexical, "QUERY_ROWS", 30)
    monkeypatch.setattr(lexical, "POSTINGS", 150)
    lists, asked, _, w = _small_index(spark)
    few = {(u, t): q + 1 for i, ((u, t), q) in enumerate(asked.items()) if i % 3 and u != 4}  # of user 4 nothing
    q = spark.createDataFrame([(*k, x, few.get(k)) for k, x in asked.items()], "user_idx long, term string, q double, q_newest double")
    ends, want = (9.5, 249.75, 499.0), []  # 9.5 and 249.75 end inside a span
    for u in range(20):
        for v, (own, end) in enumerate((own, end) for own in (few, asked) for end in ends):
            scores, bounds, n = {}, {}, {}
            for (d, t), x in lists.items():
                if (u, t) in own and d <= end:
                    scores[d] = scores.get(d, 0) + own[u, t] * x
                    bounds[d // 8, t] = max(bounds.get((d // 8, t), 0), own[u, t] * x)
                    n[d // 8] = n.get(d // 8, 0) + 1
            edge = sorted(scores.values())[-5] if len(scores) >= 5 else 0  # every term of a query is a seed
            opened = [s for s in n if sum(x for (at, _), x in bounds.items() if at == s) >= edge - 1e-6]
            if n:
                want.append((u, v, sum(n.values()), sum(n[s] for s in opened), len(n), len(opened)))
    got = lexical.span_work(q, w, 5, 8, sets=("q_newest", "q"), ends=ends)
    assert rows(got.groupBy("user_idx", "v").agg(*(F.sum(c).alias(c) for c in ("touched", "opened", "spans", "open_spans")))) == want
    assert got._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 2


def test_work_at_three_sizes_takes_two_meetings_of_blocks(spark):
    from clicklake.operators import lexical

    got = lexical.wand_scale_q(spark, "/root/testdata/sf0.001")
    assert got._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") == 2  # one pair of meetings for each size and set was twelve
    assert [tuple(r)[:2] for r in got.collect()] == [(name, share) for name in ("last read", "all read") for share in (0.25, 0.5, 1.0)]
    nothing = lexical.span_work(*(spark.createDataFrame([], s) for s in ("user_idx long, term string, q double", "doc_id long, term string, w double")), 5, 8)
    assert nothing.count() == 0


@pytest.mark.parametrize("alone", [0, 5, 10**9])
def test_bounds_are_the_same_by_products_and_one_by_one(monkeypatch, alone):
    import pyarrow as pa

    from clicklake.operators import blocks

    for name, value in (("ALONE", alone), ("CELLS", 40), ("OPENED", 7)):
        monkeypatch.setattr(blocks, name, value)
    rng = np.random.default_rng(8)
    has = np.argwhere(rng.random((12, 60)) < np.linspace(0.02, 0.9, 12)[:, None])  # (term, doc) in order; common and rare terms
    term = pa.DictionaryArray.from_arrays(pa.array(has[:, 0].astype(np.int32)), pa.array([f"t{i:02}" for i in range(12)]))
    w = rng.random(len(has))
    spans = blocks.Spans(blocks.Lists(pa.table({"doc_id": has[:, 1], "term": term})), w, 4)
    asks = np.argwhere(rng.random((5, 12)) < 0.6)
    q = rng.random(len(asks))
    n, bound = spans.sums(asks[:, 0], 5, asks[:, 1], q)
    want_n, want = np.zeros((5, 15)), np.zeros((5, 15))
    for (u, t), x in zip(asks, q):
        for s in range(15):
            own = w[(has[:, 0] == t) & (has[:, 1] // 4 == s)]
            want_n[u, s] += len(own)
            want[u, s] += x * own.max(initial=0)
    assert (n == want_n).all() and np.allclose(bound, want, atol=1e-12)
