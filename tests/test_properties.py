"""Properties: order invariance, strictly earlier reads, permutations, no aliasing, and the plans themselves."""

import io
import random
from contextlib import redirect_stdout
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from clicklake.operators.bias import ctr_stratified, ipw_weights
from clicklake.operators.candidates import drop_seen, recall_at, rrf
from clicklake.operators.evaluation import bootstrap, list_diversity, rank_metrics
from clicklake.operators.lists import dense_ids, list_rank, remap_list
from clicklake.operators.relational import slot_chunks
from clicklake.operators.sketches import count_min, count_min_estimates, similar_texts
from clicklake.operators.vectors import knn_cells, knn_exact
from clicklake.operators.windows import asof_before, dwell_features, session_features
from clicklake.plans.graph import components
from clicklake.sources.logs import pair_table
from clicklake.sources.tables import table

T0 = datetime(2024, 9, 2)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def log(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        shown = rng.sample(range(20), rng.randint(0, 6))
        data.append((i, rng.choice([1, 1, 2, 3, None]), rng.choice([None, *[T0 + timedelta(hours=rng.randrange(200))] * 9]), shown if i % 17 else None, [x for x in shown if rng.random() < 0.3], rng.choice([None, 5, 6]), rng.choice([None, float("nan"), rng.random() * 60]), rng.choice([None, rng.random() * 100])))
    return spark.createDataFrame(data, "src_row long, user_idx long, time timestamp_ntz, candidates array<long>, clicked array<long>, session_id long, read_time double, scroll_percentage double")


def test_row_order_changes_nothing(spark):
    imp = log(spark)
    mixed = imp.repartition(7).orderBy(F.rand(5))
    for op in (session_features, dwell_features, lambda x: rank_metrics(pair_table(x).withColumn("score", (F.col("article_idx") % 3).cast("double")))):
        assert rows(op(imp)) == rows(op(mixed))


def test_later_rows_change_nothing_earlier(spark):
    imp, cut = log(spark), T0 + timedelta(hours=100)
    before = imp.where(F.col("time") < F.lit(cut))
    kept = before.select(F.col("src_row").alias("imp"))
    for op in (session_features, dwell_features):
        assert rows(op(imp).join(kept, "imp", "left_semi")) == rows(op(before))


def test_asof_is_strict_and_keeps_every_left_row(spark):
    rng = random.Random(3)
    left = [(i, rng.choice([1, 1, 2, 9, None]), rng.choice([None, T0 + timedelta(hours=rng.randrange(300))])) for i in range(200)]
    right = {(rng.choice([1, 2]), T0 + timedelta(hours=rng.randrange(300))): i for i in range(80)}
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k long, t timestamp_ntz, v long")
    want = []
    for i, k, t in left:
        ok = [(u, v) for (j, u), v in right.items() if j == k and t and u < t]
        want.append((i, max(ok)[1] if ok else None))
    for width in (3600, 86400, 10**8):
        got = rows(asof_before(spark.createDataFrame(left, "i long, k long, t timestamp_ntz"), r, "k", "t", ["v"], width).select("i", "v"))
        assert got == sorted(want, key=lambda x: x[0])


def test_ranks_are_permutations_and_maps_keep_order(spark):
    df = spark.createDataFrame([(0, [3.0, 1.0, 3.0, 2.0]), (1, [5.0]), (2, [1.0, 1.0])], "id long, s array<double>")
    assert rows(df.select("id", list_rank(F.col("s")))) == [(0, [1, 4, 2, 3]), (1, [1]), (2, [1, 2])]
    ids = dense_ids(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "key string"), "key")
    assert rows(ids) == [("a", 0), ("b", 1)]
    lists = spark.createDataFrame([(0, ["b", "x", "a", "b"]), (1, []), (2, None), (3, ["x"])], "id long, l array<string>")
    assert rows(remap_list(lists, "id", "l", ids)) == [(0, [1, 0, 1]), (1, []), (2, []), (3, [])]


def test_metrics_by_hand(spark):
    data = [(1, 10, 0, False, 3.0), (1, 11, 1, True, 2.0), (1, 12, 2, True, 1.0), (2, 10, 0, False, 1.0), (2, 11, 1, False, 0.0), (3, 10, 0, True, 1.0)]
    got = {r.imp: r for r in rank_metrics(spark.createDataFrame(data, "imp long, article_idx long, position int, label boolean, score double")).collect()}
    assert got[1].auc == 0 and abs(got[1].mrr - (1 / 2 + 1 / 3) / 2) < 1e-12 and got[1].mrr_first == 0.5
    assert got[2].auc is None and got[2].mrr is None and got[2].ndcg_5 == 0 and got[3].ndcg_5 == 1 and got[3].hit_5 == 1
    tied = spark.createDataFrame([(1, i, i, i % 2 == 0, 7.0) for i in range(6)], "imp long, article_idx long, position int, label boolean, score double")
    assert rank_metrics(tied).first().auc == 0.5


def test_bootstrap_covers_the_mean(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, rng.random()) for i in range(2000)] + [(9999, None), (9998, float("nan"))], "u long, v double")
    r = bootstrap(df, "u", "v").first()
    assert r.n == 2000 and r.low < r.mean < r.high and 0.01 < r.high - r.low < 0.06
    assert rows(bootstrap(df.repartition(9), "u", "v"))[0][2:4] == (r.low, r.high) or abs(bootstrap(df.repartition(9), "u", "v").first().low - r.low) < 1e-9


def test_diversity_of_same_and_orthogonal_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0])], "article_idx long, vector array<double>")
    lists = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0)], "imp long, article_idx long")
    assert rows(list_diversity(lists, v)) == [(1, 0.0), (2, 1.0), (3, None)]


def test_search_finds_itself_and_cells_agree_when_all_are_probed(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(None, [0.0] * 8), (999, None)], "id long, vector array<double>")
    exact = rows(knn_exact(df.where("id < 20"), df, 3, size=8, block=37).select("query", "item", "rank"))
    assert [r[1] for r in exact if r[2] == 1] == list(range(20))
    assert rows(knn_cells(df.where("id < 20"), df, 3, cells=5, probe=5, size=8, block=11).select("query", "item", "rank")) == exact
    assert knn_exact(df.limit(0), df, 3, size=8).count() == 0


def test_fusion_anti_join_and_recall(spark):
    lists = spark.createDataFrame([(1, 5, "a", 2.0), (1, 6, "a", 1.0), (1, 6, "b", 9.0), (1, 7, "b", 9.0), (1, 7, None, 1.0), (None, 7, "a", 1.0), (1, 8, "a", float("nan"))], "user_idx long, article_idx long, r string, score double")
    got = rrf(lists, "r", 10)
    assert [(r.article_idx, r["rank"]) for r in got.orderBy("rank").collect()] == [(6, 1), (5, 2), (7, 3)]
    assert rows(drop_seen(got, spark.createDataFrame([(1, 6)], "user_idx long, article_idx long")).select("article_idx")) == [(5,), (7,)]
    imp = spark.createDataFrame([(1, 1, [6, 99]), (2, 2, [6]), (3, 1, []), (4, None, [6])], "src_row long, user_idx long, clicked array<long>")
    assert rows(recall_at(got, imp, (1, 5))) == [(1, 2, 0.5, 0.5), (2, 1, 0.0, 0.0)]


def test_similar_texts_are_all_pairs(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)) for _ in range(8)]
    docs = []
    for b in base:
        for k in (0, 0, 1, 2):
            w = b.split(" ")
            for _ in range(k):
                w[rng.randrange(60)] = "zz"
            docs.append(" ".join(w))
    docs += ["", None, "one two", "A  b c d e", "a b C d\ne"]
    sets = {}
    for i, d in enumerate(docs):
        t = " ".join((d or "").lower().split())
        if t and t not in [x for x, _ in sets.values()]:
            w = t.split(" ")
            sets[i] = (t, {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a][1] and sets[b][1] and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1]))
    got = rows(similar_texts(spark.createDataFrame(list(enumerate(docs)), "i long, t string"), "i", "t").select("a", "b"))
    assert got == want and want


def test_sketch_never_counts_short(spark):
    items = spark.createDataFrame([(random.Random(i).randrange(50),) for i in range(500)] + [(None,)], "x long")
    exact = items.where("x is not null").groupBy("x").count()
    est = count_min_estimates(exact, "x", count_min(items, "x", width=16), width=16)
    assert all(r.estimate >= r["count"] for r in exact.join(est, "x").collect())


def test_components_of_a_ring_and_loops(spark):
    edges = [(i, (i + 1) % 30) for i in range(30)] + [(50, 50), (61, 60)]
    assert rows(components(spark.createDataFrame(edges, "a long, b long"))) == [(i, 0) for i in range(30)] + [(60, 60), (61, 60)]


def test_chunks_hold_their_budget(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.randint(0, 9)) for i in range(500)], "o long, s long")
    got = slot_chunks(df, "o", "s", 40, span=64).groupBy("chunk").agg(F.sum("s").alias("s"), F.min("o").alias("a"), F.max("o").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert all(r.s <= 40 + 9 and r.b - r.a + 1 == r.n for r in got) and sum(r.n for r in got) == 500


def test_bias_curves_stand_little_data(spark):
    pairs = pair_table(log(spark))
    assert ctr_stratified(pairs, least_lists=10**6).count() == 0
    weights = rows(ipw_weights(spark.createDataFrame([(0, 1.0), (2, 0.01)], "position int, propensity double"), 4))
    assert weights == [(0, 1.0), (1, 1.0), (2, 10.0), (3, 10.0)]


def test_plans(spark):
    folder = "/root/testdata/sf0.001"
    from clicklake.queries import registered

    q = registered("QUERIES")
    text = plan(q["time_window"](spark, folder))
    assert "PushedFilters: [IsNotNull(time), GreaterThanOrEqual(time" in text
    text = plan(q["p2_found"](spark, folder))
    assert "ReadSchema: struct<pair_id:bigint,article_idx:bigint,time:timestamp_ntz,label:boolean>" in text and text.count("Exchange hashpartitioning") <= 6
    for name in ("p2_found", "p4_found", "p6_found", "join_semi", "session_features", "remap_list", "stage1"):
        text = plan(q[name](spark, folder))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert "WindowGroupLimit" in plan(q["topk_partial"](spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan(table(spark, folder, "lineitem").groupBy("l_orderkey").count())
