"""Boosted trees and the wide feature join: losses against finite differences, and no look ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklake.operators import trees
from clicklake.operators.ranking import FAMILIES, GREY, PRODUCTION, SHIPPED, _rounded, attach_features, fit_ranker, score_trees
from clicklake.sources.logs import articles, at, histories, impressions, pair_table

FOLDER = "/root/testdata/sf0.001"


def test_families_ship_nothing_the_server_does_not_know():
    shipped = {c for f in SHIPPED for c in FAMILIES[f]}
    assert not shipped & set(FAMILIES["grey"]) and not shipped & set(FAMILIES["rolling"])
    assert set(PRODUCTION) == {*SHIPPED, "rolling"} and set(GREY) == set(FAMILIES)
    every = [c for f in FAMILIES for c in FAMILIES[f]]
    assert len(every) == len(set(every))


def test_listwise_pull_is_the_weighted_slope_of_pairs():
    rng = np.random.default_rng(1)
    group = np.repeat([3, 1, 2], [6, 5, 4])
    y = np.array([0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0], float)
    f = rng.normal(size=15)
    g, h = trees.listwise(y, group)(f)
    want = np.zeros(15)
    for k in (1, 2, 3):
        at_ = np.flatnonzero(group == k)
        rank = np.argsort(np.argsort(-f[at_], kind="stable"), kind="stable")
        ideal = sum(1 / np.log2(i + 2) for i in range(int(y[at_].sum()))) or 1
        for i, a in enumerate(at_):
            for j, b in enumerate(at_):
                if y[a] > y[b]:
                    swap = abs(1 / np.log2(rank[i] + 2) - 1 / np.log2(rank[j] + 2)) / ideal
                    p = swap / (1 + np.exp(f[a] - f[b]))
                    want[a] -= p
                    want[b] += p
    assert np.allclose(g, want) and (h > 0).all() and (g[group == 2] == 0).all()


@pytest.mark.parametrize("objective", ["listwise", "pointwise"])
def test_trees_learn_an_order_with_nulls(objective):
    rng = np.random.default_rng(2)
    group = np.repeat(np.arange(400), 8)
    x = rng.normal(size=(3200, 3))
    hidden = x[:, 0] - 2 * np.abs(x[:, 1])
    x[rng.random(3200) < 0.1, 2] = np.nan
    y = np.zeros(3200)
    for k in range(400):
        y[k * 8 + hidden[k * 8 : k * 8 + 8].argmax()] = 1
    a, b = group < 300, group >= 300
    loss = trees.listwise(y[a], group[a]) if objective == "listwise" else trees.logistic(y[a])
    m = trees.fit(x[a], loss, watch=(x[b], lambda f: trees.ndcg(f, y[b], group[b])))
    assert trees.ndcg(m.score(x[b]), y[b], group[b]) > 0.85 and m.gains[2] < 0.1 * m.gains.sum()
    none = trees.fit(np.zeros((0, 3)), loss)
    assert (none.score(x[:5]) == 0).all()


def test_features_know_nothing_of_their_window(spark):
    """Clicks in and after the window change no counted feature of its rows; rows after an instant change nothing before it."""
    since, until = "2024-10-01 00:00:00", "2024-10-08 00:00:00"
    imp, history, article = impressions(spark, FOLDER).cache(), histories(spark, FOLDER), articles(spark, FOLDER)
    window = imp.where((F.col("time") >= at(since)) & (F.col("time") < at(until)))
    match = spark.createDataFrame([], "user_idx bigint, article_idx bigint, bm25 double, emb_cos double, emb_max double, emb_recent double")
    features = lambda log: _rounded(attach_features(pair_table(window), log, history, article, match, since))
    counted = ["imp", "position", *FAMILIES["user"][:7], "ctr_smoothed", "clicks_decayed", "prior_clicks", "prior_inview", "cat_clicks"]
    whole = features(imp).select(*counted).toArrow().to_pylist()
    blind = features(imp.withColumn("clicked", F.when(F.col("time") < at(since), F.col("clicked")))).select(*counted).toArrow().to_pylist()
    key = lambda r: (r["imp"], r["position"])
    assert sorted(whole, key=key) == sorted(blind, key=key)
    full = [r for r in features(imp).toArrow().to_pylist()]
    cut = features(imp.where((F.col("time") < at(until)) | F.col("time").isNull())).toArrow().to_pylist()
    assert sorted(full, key=key) == sorted(cut, key=key)
    imp.unpersist()


def test_ranker_scores_where_rows_lie(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(j), int(j), bool(j == 0), float(rng.normal() + 3 * (j == 0)), None if j % 2 else 1.0) for i in range(80) for j in range(5)]
    df = spark.createDataFrame(rows, "imp bigint, article_idx bigint, position int, label boolean, x double, position_frac double").repartition(3)
    names = ["x", "position_frac", "position"]
    got = score_trees(fit_ranker(df, names, impressions_most=50), df, names)
    best = got.groupBy("imp").agg(F.max_by("label", "score").alias("hit")).agg(F.avg(F.col("hit").cast("double"))).first()[0]
    assert got.count() == 400 and best > 0.9
    assert score_trees(fit_ranker(df.limit(0), names), df, names).where("score <> 0").count() == 0
