"""Boosted trees: planted targets, the same trees under any partitioning, feature subsets, weights, limits, saving; a plain reference tree."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regrove.operators.metrics import regression_metrics
from regrove.plans import boosting
from regrove.plans.boosting import Boosting, Symmetric, fit_boosting

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    r = np.random.default_rng(3)
    x = r.integers(0, 30, (1200, 3)).astype(float)
    y = 5.0 * (x[:, 0] > 11) + 2.0 * (x[:, 1] > 20) * (x[:, 0] > 11) + 0.1 * x[:, 2] + r.normal(0, 0.3, 1200)
    rows = [(i, *(None if (i + j) % 97 == 0 else float(v) for j, v in enumerate(row)), float(t)) for i, (row, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").cache()


PROFILES = {
    "boost_regularised": {"n_estimators": 12, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample_bytree": 0.7},
    "boost_leaves": {"n_estimators": 12, "num_leaves": 6, "learning_rate": 0.3, "min_child_samples": 5, "subsample": 0.8},
    "boost_symmetric": {"iterations": 12, "depth": 3, "learning_rate": 0.3, "bagging_temperature": 0.7, "random_strength": 1.0},
}


@pytest.mark.parametrize("name", list(PROFILES))
def test_each_shape_finds_the_target_and_is_the_same_under_any_partitioning(spark, table, tmp_path, name):
    own = boosting.settings(name, PROFILES[name])
    first = fit_boosting(table, NAMES, "y", ["id"], own)
    again = fit_boosting(table.repartition(7, "c").sortWithinPartitions("y"), NAMES, "y", ["id"], own)
    assert again.trees == first.trees and again.base == pytest.approx(first.base)
    scored = first.transform(table)
    assert scored.columns == [*table.columns, "prediction"]
    assert regression_metrics(scored, "y", by=None).first()["r2"] > 0.9
    assert first.importance(spark).first()["feature"] == "a"
    first.save(spark, f"{tmp_path}/{name}")
    held = boosting.BoostedTrees.load(spark, f"{tmp_path}/{name}")
    assert held == first
    assert held.transform(table).exceptAll(scored).count() == 0


def test_limits_hold(table):
    few = fit_boosting(table, NAMES, "y", ["id"], Boosting("leaves", 3, max_leaves=4, min_child_samples=100))
    assert all(t.feature.count(-1) <= 4 for t in few.trees)
    counts = fit_counts(table, few)
    assert min(counts[0].values()) >= 100
    deep = fit_boosting(table, NAMES, "y", ["id"], Boosting("leaves", 1, max_leaves=100, max_depth=2))
    assert deep.trees[0].feature.count(-1) <= 4
    symmetric = fit_boosting(table, NAMES, "y", ["id"], Boosting("symmetric", 2, max_depth=3, min_child_weight=0))
    assert all(len(t.value) == 8 for t in symmetric.trees)
    assert fit_boosting(table, NAMES, "y", ["id"], Boosting("depth", 1, gamma=1e9)).trees[0].feature == [-1]
    assert fit_boosting(table, NAMES, "y", ["id"], Boosting("depth", 1, reg_alpha=1e9)).trees[0].value == [0.0]


def matrix(df, model):
    rows = np.array([[math.nan if v is None else v for v in r] for r in df.select(*model.features).collect()], float)
    return boosting.binned(list(rows.T), [np.array(b) for b in model.borders])


def fit_counts(df, model):
    rows = matrix(df, model)
    return [dict(zip(*np.unique(t.at(rows), return_counts=True))) for t in model.trees]


def test_each_tree_uses_its_feature_subset(table):
    model = fit_boosting(table, NAMES, "y", ["id"], Boosting(trees=8, max_depth=2, column_share=0.4))
    subsets = [boosting.tree_features(NAMES, 0.4, 42, k) for k in range(8)]
    assert len({tuple(s) for s in subsets}) > 1 and all(len(s) == 1 for s in subsets)
    for tree, subset in zip(model.trees, subsets):
        assert set(tree.feature) - {-1} <= set(subset)


def test_best_first_growth_takes_the_highest_gains(table):
    """Against one-by-one growth: the leaf with the highest gain, its children summed up after it."""
    own = Boosting("leaves", 1, 1.0, max_leaves=7, reg_lambda=0.5)
    model = fit_boosting(table, NAMES, "y", ["id"], own)
    rows, y = matrix(table, model), np.array([r["y"] for r in table.select("y").collect()])
    e = y - y.mean()

    def best(at):
        score = lambda m: e[m].sum() ** 2 / (m.sum() + 0.5)
        found = (0.0, 0, 0)
        for f in range(3):
            for b in range(int(rows[:, f].max())):
                low, high = at & (rows[:, f] <= b), at & (rows[:, f] > b)
                if low.any() and high.any():
                    gain = 0.5 * (score(low) + score(high) - score(at))
                    found = max(found, (gain, -f, -b))
        return found[0], -found[1], -found[2]

    leaves = [np.ones(len(y), bool)]
    while len(leaves) < 7:
        gains = [best(at) for at in leaves]
        k = max(range(len(leaves)), key=lambda i: gains[i][0])
        at = leaves.pop(k)
        low = rows[:, gains[k][1]] <= gains[k][2]
        leaves += [at & low, at & ~low]
    expected = np.zeros(len(y))
    for at in leaves:
        expected[at] = e[at].sum() / (at.sum() + 0.5)
    assert np.abs(model.trees[0].predict(rows) - expected).max() < 1e-6


def test_symmetric_trees_score_by_bits():
    tree = Symmetric([0, 1], [3, 5], [1.0, 2.0, 3.0, 4.0], [0.0, 0.0])
    rows = np.array([[3, 5], [4, 5], [3, 6], [4, 6]], np.uint8)
    assert tree.predict(rows).tolist() == [1.0, 2.0, 3.0, 4.0]


def test_odd_tables(spark, table):
    with pytest.raises(ValueError):
        fit_boosting(table.where("id < 0"), NAMES, "y", ["id"], Boosting(trees=1))
    with pytest.raises(ValueError):
        boosting.settings("boost_leaves", {"depth": 3})
    constant = fit_boosting(table.withColumn("y", F.lit(2.0)), NAMES, "y", ["id"], Boosting(trees=2))
    assert constant.base == 2.0 and all(t.value == [0.0] for t in constant.trees)
    nothing = table.withColumn("a", F.lit(None).cast("double"))
    model = fit_boosting(nothing, NAMES, "y", ["id"], Boosting(trees=2, max_depth=2))
    assert model.borders[0] == () and model.transform(nothing).where("prediction is null").count() == 0
    single = fit_boosting(table.where("id = 5"), NAMES, "y", ["id"], Boosting(trees=1))
    assert single.trees[0].value == [0.0]


def test_reference_ranges_have_their_settings():
    for name, space in boosting.SPACES.items():
        low = boosting.settings(name, {k: v.low for k, v in space.items()})
        assert low.trees == 100


def test_search_over_a_profile(table):
    from regrove.plans.learners import Fixed, Int

    space = {"n_estimators": Fixed(6), "num_leaves": Int(2, 8), "learning_rate": Fixed(0.5)}
    study = boosting.tune_boosting(table.where("id % 4 > 0"), table.where("id % 4 = 0"), NAMES, "y", ["id"], "boost_leaves", 3, 1, space)
    assert len(study.trials) == 3 and study.best[1] < 2


@pytest.mark.parametrize("growth", ["depth", "symmetric"])
def test_leaves_need_no_pass_of_their_own(spark, monkeypatch, growth):
    table = spark.createDataFrame([(i, float(i % 8), float(i % 3), float((i % 8 > 3) * 10 + (i % 3))) for i in range(400)], "id long, a double, b double, y double")
    passes, sums = [], boosting._Rows.sums
    monkeypatch.setattr(boosting._Rows, "sums", lambda *args: passes.append(1) or sums(*args))
    model = boosting.fit_boosting(table, ["a", "b"], "y", ["id"], boosting.Boosting(growth, trees=1, learning_rate=1.0, max_depth=2, reg_lambda=0.0))
    assert len(passes) == 2
    means = {(r.high, r.one): r.m for r in table.groupBy((F.col("a") > 3).alias("high"), (F.col("b") > 0).alias("one")).agg(F.avg("y").alias("m")).collect()}
    for r in model.transform(table).collect():
        assert abs(r.prediction - means[r.a > 3, r.b > 0]) < 1e-6
