import math

import pytest

from regrove.catalog import FEATURE_GROUPS, FEATURES
from regrove.functions.nulls import nan_to_null
from regrove.operators import profile
from regrove.operators.explore import numeric_features
from regrove.sources.tables import ensure_schema, load
from regrove.sources.trips import TRIP_KEY, trips

NAN = float("nan")


@pytest.fixture()
def null_nan(spark):
    return spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (4.0, 9.0), (5.0, NAN)], "a double, b double")


def test_nan_counts_as_missing(null_nan):
    rows = profile.missing_profile(null_nan).collect()
    assert [tuple(r)[1:] for r in rows] == [("b", 2, 40.0)]
    assert profile.with_target(null_nan, "b").count() == 3
    assert [r.b for r in nan_to_null(null_nan).orderBy("a").collect()] == [2.0, 4.0, None, 9.0, None]
    assert profile.column_range(null_nan, "b").first()["n_distinct"] == 3


def test_missing_profile_orders_by_count_then_name_and_rounds_half_even(spark):
    df = spark.createDataFrame([(None, None, 1, None)] * 1 + [(1, 1, 1, None)] * 799, "z int, b int, full int, empty int")
    rows = [tuple(r)[1:] for r in profile.missing_profile(df).collect()]
    assert rows == [("empty", 800, 100.0), ("b", 1, 0.12), ("z", 1, 0.12)]


def test_missing_profile_over_several_passes(spark, monkeypatch):
    monkeypatch.setattr(profile, "COLUMNS_PER_PASS", 2)
    df = spark.createDataFrame([(1, None, 3, None, 5), (1, 2, 3, None, 5)], "a int, b int, c int, d int, e int")
    assert [tuple(r)[1:] for r in profile.missing_profile(df).collect()] == [("d", 2, 100.0), ("b", 1, 50.0)]


def test_target_summary(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,), (NAN,)], "y double")
    r = profile.describe_target(df, "y").first()
    assert (r.n_present, r["mean"], r["median"], r["min"], r["max"], r.all_null) == (4, 4.0, 3.0, 1.0, 9.0, False)
    assert math.isclose(r["std"], math.sqrt(38 / 3))


def test_target_summary_of_nothing(spark):
    for df in (spark.createDataFrame([(None,), (NAN,)], "y double"), spark.createDataFrame([], "y double")):
        r = profile.describe_target(df, "y").first()
        assert r.all_null and r["median"] is None and r["mean"] is None
    single = profile.describe_target(spark.createDataFrame([(3.0,)], "y double"), "y").first()
    assert single["std"] is None and single["median"] == 3.0


def test_empty_frame_keeps_schemas(spark):
    df = spark.createDataFrame([], "a double, y double")
    assert profile.shape(df).first() == (0, 2)
    assert profile.missing_profile(df).collect() == []
    assert profile.feature_catalog(df, {"g": ["a", "nope"]}).first().null_pct is None
    assert profile.distinct_sample(df, ["a"]).columns == ["ordinal", "column", "value"]


def test_catalogue_keeps_order_and_skips_absent_columns(spark, sf):
    df = trips(spark, sf)
    rows = profile.feature_catalog(df, FEATURE_GROUPS).collect()
    present = set(df.columns)
    assert [r["column"] for r in rows] == [c for cols in FEATURE_GROUPS.values() for c in cols if c in present]
    assert rows[0]["group"] == "ID Features" and rows[0]["data_type"] == "bigint"


def test_distinct_sample_is_sorted_with_missing_last(spark):
    df = spark.createDataFrame([(i % 12,) for i in range(40)] + [(None,)], "a int")
    assert [r.value for r in profile.distinct_sample(df, ["a"], 10).collect()] == [str(i) for i in range(10)]
    few = spark.createDataFrame([(2,), (None,), (1,), (2,)], "a int")
    assert [r.value for r in profile.distinct_sample(few, ["a", "gone"]).collect()] == ["1", "2", None]


def test_types_and_presence(spark):
    df = spark.createDataFrame([("s", None, True, 1.0)], "s string, d decimal(10,2), f boolean, x double")
    assert numeric_features(df) == ["x"]
    assert {r.data_type: r.n_columns for r in profile.dtype_counts(df).collect()} == {
        "string": 1, "decimal(10,2)": 1, "boolean": 1, "double": 1}
    assert [(r.column, r.present) for r in profile.feature_presence(df, ["x", "q"]).collect()] == [("x", True), ("q", False)]


def test_select_features_in_declared_order(spark, sf):
    out = profile.select_features(trips(spark, sf), ["max_speed_kmh", "nope", "distance_km"], ["l_orderkey"])
    assert out.columns == ["l_orderkey", "max_speed_kmh", "distance_km"]
    with pytest.raises(ValueError):
        profile.with_target(out, "nope")


def test_column_names_with_dots_and_spaces(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0)], "`a.b` double, `c d` double")
    assert [tuple(r)[1:] for r in profile.missing_profile(df).collect()] == [("c d", 1, 50.0)]
    assert profile.select_features(nan_to_null(df), ["a.b"]).columns == ["a.b"]


def test_load_by_name_and_path(spark, sf, tmp_path):
    ensure_schema(spark, "feature_store")
    ensure_schema(spark, "feature_store")
    spark.range(3).write.mode("overwrite").saveAsTable("feature_store.numbers")
    assert load(spark, "feature_store.numbers", catalog=None).count() == 3
    assert load(spark, "feature_store.numbers", catalog="spark_catalog").count() == 3
    assert "l_orderkey" in load(spark, f"{sf}/lineitem.parquet").columns
    with pytest.raises(ValueError):
        ensure_schema(spark, "x; DROP SCHEMA y")


def test_trip_frame_reads_only_what_it_needs(spark, sf):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    narrow = plan(trips(spark, sf, [*TRIP_KEY, "distance_km"]))
    assert "orders" not in narrow and "supplier" not in narrow and "l_shipdate" not in narrow
    assert trips(spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    pushed = plan(profile.with_target(trips(spark, sf, ["distance_km"]), "distance_km"))
    assert "PushedFilters: [IsNotNull(l_quantity)]" in pushed


def test_fixed_names():
    assert len(FEATURES) == len(set(FEATURES)) == 45
    assert sum(map(len, FEATURE_GROUPS.values())) == 33
