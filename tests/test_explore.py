import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrove.operators import explore

NAN = float("nan")


def as_dict(df):
    return {r.feature: r.r for r in df.collect()}


@pytest.fixture(scope="module")
def wild():
    """Columns with nulls, far-off means, constants, and a column that never meets the target."""
    rng = np.random.default_rng(7)
    n = 900
    y = rng.normal(size=n)
    frame = pd.DataFrame({
        "y": y, "x": y * 2 + rng.normal(size=n), "far": 1e9 + y + rng.normal(size=n) * 0.5,
        "k": 0.1, "noise": rng.normal(size=n), "whole": rng.integers(0, 5, n),
        "apart": np.where(np.arange(n) < 30, 1.0 * np.arange(n), np.nan),
    })
    frame.loc[:29, "y"] = np.nan
    frame.loc[rng.random(n) < 0.3, "x"] = np.nan
    return frame


def to_spark(spark, frame, parts):
    return spark.createDataFrame(frame).repartition(parts)


@pytest.mark.parametrize("parts", [1, 7])
def test_target_correlation_matches_pandas(spark, wild, parts):
    got = as_dict(explore.target_correlation(to_spark(spark, wild, parts), "y"))
    # pandas' running mean loses digits on the far-off column; correlation ignores a shift
    expected = wild.assign(far=wild.far - 1e9).corr()["y"]
    assert set(got) == set(wild.columns)
    assert got["k"] is None and got["apart"] is None
    for c in ("y", "x", "far", "noise", "whole"):
        assert math.isclose(got[c], expected[c], abs_tol=1e-9), c


def test_order_is_signed_descending_undefined_last(spark, wild):
    rows = explore.target_correlation(to_spark(spark, wild, 3), "y").collect()
    values = [r.r for r in rows]
    known = [v for v in values if v is not None]
    assert rows[0].feature == "y" and known == sorted(known, reverse=True)
    assert values[len(known):] == [None] * (len(values) - len(known))
    assert [r.feature for r in rows[-2:]] == ["apart", "k"]


def test_constant_spread_over_tasks_stays_undefined(spark):
    df = spark.range(0, 1000, 1, 13).select(F.lit(0.1).alias("k"), F.col("id").cast("double").alias("y"))
    assert as_dict(explore.target_correlation(df, "y"))["k"] is None


def test_guards(spark):
    assert explore.target_status(spark.createDataFrame([(1.0, NAN), (1.0, None)], "a double, y double"), "y") == "all_null"
    assert explore.target_status(spark.range(3), "y") == "no_column"
    assert explore.target_status(spark.range(3), "id") == "ok"
    empty = spark.createDataFrame([(1.0, None), (2.0, NAN)], "a double, y double")
    assert explore.target_correlation(empty, "y").collect() == []
    assert explore.target_correlation(empty, "gone").collect() == []
    one = spark.createDataFrame([(1.0, 2.0)], "a double, y double")
    assert as_dict(explore.target_correlation(one, "y")) == {"a": None, "y": None}


@pytest.mark.parametrize("parts", [1, 5])
def test_matrix_is_symmetric_and_pairwise(spark, wild, parts):
    columns = ["y", "x", "far", "noise", "k", "apart"]
    rows = explore.correlation_matrix(to_spark(spark, wild, parts), columns).collect()
    got = {(r.a, r.b): r.r for r in rows}
    assert len(rows) == len(got) == 36
    expected = wild.assign(far=wild.far - 1e9)[columns].corr()
    for (a, b), r in got.items():
        assert r == got[(b, a)]
        e = expected.loc[a, b]
        assert (r is None and math.isnan(e)) or math.isclose(r, e, abs_tol=1e-9), (a, b)


def test_leakage_names_but_keeps_target_out(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, -3.0 * i, float(i % 3)) for i in range(50)],
                               "y double, up double, down double, other double")
    ranked = explore.target_correlation(df, "y")
    assert sorted(r.feature for r in explore.leakage_check(ranked, "y").collect()) == ["down", "up"]
    assert explore.suggested_exclusions(explore.leakage_check(ranked, "y")) == ["down", "up"]
    assert [r.feature for r in explore.top_correlations(ranked, 2).collect()] == ["up", "y"]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 9.0, 10.0], [5.0, 5.0], [0.1 * i for i in range(101)]])
@pytest.mark.parametrize("bins", [4, 50])
def test_histogram_matches_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in [*values, NAN, None]], "v double")
    rows = explore.histogram(df, "v", bins).collect()
    counts, edges = np.histogram(values, bins=bins)
    assert sum(r.n for r in rows) == len(values) and len(rows) == bins
    assert np.allclose([r.lo for r in rows] + [rows[-1].hi], edges)
    assert math.isclose(rows[0]["mean"], np.mean(values))
    if bins == 4:
        assert [r.n for r in rows] == list(counts)


def test_histogram_and_scatter_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (NAN, 2.0)], "x double, y double")
    assert explore.histogram(df, "x").collect() == []
    assert explore.scatter_bins(df, "x", "y").collect() == []
    assert explore.scatter_points(df, "x", "y").count() == 0


def test_scatter_bins_count_every_complete_row(spark, wild):
    df = to_spark(spark, wild, 3)
    cells = explore.scatter_bins(df, "x", "y", 10).collect()
    complete = wild.dropna(subset=["x", "y"])
    counts, _, _ = np.histogram2d(complete.x, complete.y, bins=10)
    assert {(c.x_bin, c.y_bin): c.n for c in cells} == {
        (i, j): int(counts[i, j]) for i in range(10) for j in range(10) if counts[i, j]}
    assert explore.scatter_points(df, "x", "y").count() == len(complete)
    thin = explore.scatter_points(df.coalesce(1), "x", "y", 0.5, ["x", "y"])
    assert thin.count() == thin.count() < len(complete)
