import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from regrove.operators import features, history

START = datetime(2020, 1, 1)


@pytest.fixture(scope="module")
def journeys():
    """Two vehicles and routes, one holding most rows; ties in time, gaps, and missing values."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(500):
        hot = rng.random() < 0.8
        ts = START + timedelta(seconds=int(rng.integers(0, 200)) * 43200 + int(rng.integers(0, 3)))
        rows.append((
            i, 1 if hot else 2 + i % 3, "hot" if hot else f"r{i % 4}", ts, float(rng.normal(100, 9)),
            float(rng.integers(0, 5)), float(rng.normal(30, 4)) if rng.random() < 0.7 else math.nan, float(rng.normal(60, 5)),
        ))
    return pd.DataFrame(rows, columns=["id", "VehId", "route", "ts", "energy", "distance_km", "duration", "speed"])


def close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or math.isnan(b)
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)


def test_vehicle_history_by_brute_force(spark, journeys):
    df = spark.createDataFrame(journeys).repartition(6)
    got = history.vehicle_history(df, ts="ts", energy="energy").toPandas().set_index("id")
    assert len(got) == len(journeys)
    span = timedelta(days=30)
    for row in journeys.itertuples():
        past = journeys[(journeys.VehId == row.VehId) & (journeys.ts >= row.ts - span) & (journeys.ts < row.ts)]
        g = got.loc[row.id]
        assert g.vehicle_trip_count_last30 == len(past)
        moved = past[past.distance_km > 0]
        assert close(g.vehicle_avg_efficiency_last30, (moved.energy / moved.distance_km).mean())
        assert close(g.vehicle_avg_energy_last30, past.energy.mean())
        assert close(g.vehicle_stddev_energy_last30, past.energy.std())
        assert close(g.vehicle_avg_distance_last30, past.distance_km.mean())


def test_vehicle_history_edges_of_the_window(spark):
    at = [START, START + timedelta(days=30), START + timedelta(days=30, seconds=1), START + timedelta(days=60, seconds=1)]
    df = spark.createDataFrame([(i, 1, t, 10.0, 1.0) for i, t in enumerate(at)] + [(9, None, START, 1.0, 1.0)],
                               "id int, VehId int, ts timestamp, energy double, distance_km double")
    got = {r.id: r.vehicle_trip_count_last30 for r in history.vehicle_history(df, ts="ts", energy="energy").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 9: None}


def route_by_brute_force(journeys):
    ordered = journeys.sort_values(["ts", "id"])
    expected = {}
    for _, group in ordered.groupby("route"):
        for pos, row in enumerate(group.itertuples()):
            last = group.iloc[max(0, pos - 10):pos]
            expected[row.id] = (last.energy.mean(), last.duration.mean(), last.speed.mean(), pos)
    return expected


@pytest.mark.parametrize("block_rows", [100_000, 40, 12, 10])
def test_route_history_by_brute_force(spark, journeys, block_rows):
    df = spark.createDataFrame(journeys).repartition(6)
    out = history.route_history(df, ["route"], ["id"], "ts", "energy", "duration", "speed", block_rows=block_rows)
    got = {r.id: r for r in out.collect()}
    expected = route_by_brute_force(journeys)
    assert len(got) == out.count() == len(expected)
    for i, (energy, duration, speed, before) in expected.items():
        r = got[i]
        assert r.route_trip_count == before
        assert close(r.route_avg_energy_last10, energy) and close(r.route_avg_speed_last10, speed)
        assert close(r.route_avg_duration_last10, duration)


@pytest.mark.parametrize("tie", ["id", None, 5])
def test_one_route_in_one_second(spark, tie):
    """Everything hangs on the last key column: positions are still exact and no task holds the route."""
    rows = [("r", datetime(2024, 1, 1), tie if tie != "id" else i, i, float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "route string, ts timestamp, tie int, id int, energy double").withColumns({"duration": F.col("energy"), "speed": F.col("energy")})
    out = history.route_history(df.repartition(5), ["route"], ["tie", "id"], "ts", "energy", "duration", "speed", block_rows=100)
    got = out.orderBy("id").collect()
    assert [r.route_trip_count for r in got] == list(range(3000))
    assert got[0].route_avg_energy_last10 is None and all(r.route_avg_energy_last10 == r.id - 5.5 for r in got[10:])
    assert got[5].route_avg_energy_last10 == 2.0


def test_one_busy_vehicle(spark):
    df = spark.range(60_000).select(F.lit(1).alias("v"), F.timestamp_seconds(F.col("id") * 290).alias("ts"), F.col("id").cast("double").alias("e"), F.lit(2.0).alias("d"))
    out = history.vehicle_history(df, "v", "ts", "e", "d")
    assert out.agg(F.max("vehicle_trip_count_last30")).first()[0] == 30 * 86400 // 290


def test_fleet_ratio(spark):
    df = spark.createDataFrame([(10.0, 2.0, 5.0), (30.0, 2.0, None)], "e double, d double, vehicle_avg_efficiency_last30 double")
    rows = history.fleet_ratio(df, history.fleet_efficiency(df, "e", "d")).collect()
    assert rows[0].vehicle_efficiency_vs_fleet == 0.5 and rows[1].vehicle_efficiency_vs_fleet is None


def test_row_features(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 6, 2, 8, 30), 10.0, 20.0, 40.0, 80.0, 5.0, 50.0, 60.0, 30.0, 100.0, 42.125, 1.0, 2.0, 3.0),
         (datetime(2024, 6, 3, 12, 0), 0.0, 0.0, None, 80.0, None, 50.0, 60.0, 30.0, None, 42.135, 1.0, 2.0, 3.0)],
        "feature_timestamp timestamp, distance_km double, duration_minutes double, avg_speed_kmh double, max_speed_kmh double, "
        "elevation_gain_m double, avg_battery_soc double, max_battery_soc double, min_battery_soc double, "
        "target_energy_consumption double, origin_lat double, origin_lon double, dest_lat double, dest_lon double")
    a, b = features.row_features(df).orderBy("feature_timestamp").collect()
    assert (a.trip_year, a.trip_month, a.trip_dayofweek, a.trip_hour) == (2024, 6, 1, 8)
    assert (a.is_rush_hour, a.is_weekend, b.is_rush_hour, b.is_weekend) == (1, 1, 0, 0)
    assert math.isclose(a.hour_sin, math.sin(2 * math.pi * 8 / 24)) and math.isclose(b.hour_cos, -1.0)
    assert (a.origin_lat_rounded, b.origin_lat_rounded) == (42.12, 42.14)
    assert (a.speed_squared, a.speed_per_distance, a.speed_variability) == (1600.0, 4.0, 40.0)
    assert (a.actual_speed_efficiency, a.speed_efficiency_ratio, a.battery_usage_rate, a.energy_per_km) == (30.0, 0.5, 1.5, 10.0)
    assert (a.distance_category, a.speed_category) == (1, 2)
    assert b.speed_category is None and b.distance_category == 0
    for c in ("speed_per_distance", "duration_per_distance", "actual_speed_efficiency", "battery_usage_rate", "energy_per_km",
              "elevation_gradient", "trip_complexity_score"):
        assert b[c] is None


def test_whole_feature_table(spark, sf):
    from regrove.catalog import FEATURES, TARGET
    from regrove.sources.feature_table import feature_table

    table = feature_table(spark, sf)
    assert [c for c in [*FEATURES, TARGET] if c not in table.columns] == []
    assert table.select(F.count("*"), F.count("route_trip_count"), F.count("vehicle_trip_count_last30")).first() == (6000, 6000, 6000)


def test_feature_table_is_written_once_and_read_by_column(spark, sf):
    from regrove.sources.feature_table import feature_table

    feature_table(spark, sf)
    tracker, group = spark.sparkContext.statusTracker(), "feature-table-plan"
    spark.sparkContext.setJobGroup(group, group)
    try:
        narrow = feature_table(spark, sf, ["VehId", "speed_squared"])
    finally:
        jobs = tracker.getJobIdsForGroup(group)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(jobs) == [] and narrow.columns == ["VehId", "speed_squared"]
    plan = narrow.agg(F.sum("speed_squared"))._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):]
    assert "speed_squared" in read and "VehId" not in read and "Window" not in plan


@pytest.mark.parametrize("block_rows", [100_000, 3])
def test_routes_over_many_small_partitions(spark, block_rows):
    """Routes that go on through partitions of fewer rows than the window, null and NaN routes; the sorted rows aren't moved again."""
    rng = np.random.default_rng(5)
    routes = [None, math.nan, 0.5, 0.5, 0.5, 2.0]
    rows = [(i, routes[int(rng.integers(0, 6))], START + timedelta(seconds=int(rng.integers(0, 9))), float(rng.integers(0, 99)) if i % 5 else None) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, route double, ts timestamp, energy double").withColumns({"duration": F.col("energy"), "speed": F.col("energy") * 2})
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = history.route_history(df, ["route"], ["id"], "ts", "energy", "duration", "speed", block_rows=block_rows)
        got = {r.id: r for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "Window" not in plan and "hashpartitioning" not in plan
    assert len(got) == len(rows)
    for name in {str(r[1]) for r in rows}:
        past = []
        for i, _, _, energy in sorted((r for r in rows if str(r[1]) == name), key=lambda r: (r[2], r[0])):
            last = [e for e in past[-10:] if e is not None]
            assert got[i].route_trip_count == len(past)
            assert close(got[i].route_avg_energy_last10, sum(last) / len(last) if last else None)
            assert close(got[i].route_avg_speed_last10, 2 * sum(last) / len(last) if last else None)
            past.append(energy)


def test_a_vehicles_sums_are_dealt_once(spark, journeys):
    """Sums, tiles and running sums share one shuffle of four columns; the trips and their history meet by two more."""
    df = spark.createDataFrame(journeys)
    plan = history.vehicle_history(df, ts="ts", energy="energy")._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.rindex("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan
    assert initial.count("Exchange hashpartitioning") + initial.count("BroadcastExchange") <= 3


def test_a_repeated_order_makes_trips_that_count(spark, sf, tmp_path):
    """A dimension's repeated key multiplies trips; the feature table's histories count them all, as over the joined frame."""
    from regrove.functions.nulls import nan_to_null
    from regrove.sources.feature_table import feature_table
    from regrove.sources.trips import TRIP_KEY, trips

    for name in ("lineitem", "customer", "supplier"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    orders.union(orders.where("o_orderkey % 5 = 0")).write.parquet(f"{tmp_path}/orders.parquet")
    count = "vehicle_trip_count_last30"
    expected = history.vehicle_history(nan_to_null(trips(spark, str(tmp_path))))
    rows = lambda df: sorted(map(str, df.select(*TRIP_KEY, count).collect()))
    assert rows(feature_table(spark, str(tmp_path))) == rows(expected)


def test_trips_move_once_for_their_vehicles_past(spark, journeys):
    """The trips keep their columns through the one shuffle by vehicle and time, and nothing is joined back."""
    plan = history.vehicle_history(spark.createDataFrame(journeys), ts="ts", energy="energy")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_trips_of_unknown_vehicle_or_time_are_spread(spark):
    rows = spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, 1).alias("v"), F.when(F.col("id") % 2 == 1, F.lit(START)).alias("ts"), F.lit(1.0).alias("e"), F.lit(2.0).alias("d"))
    out = history.vehicle_history(rows.repartition(3), "v", "ts", "e", "d")
    known = [F.count(c) for c in history.VEHICLE_COLUMNS]
    assert tuple(out.agg(F.count("*"), F.count_distinct("id"), *known).first()) == (4000, 4000, 0, 0, 0, 0, 0)
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 1000


def test_features_of_several_columns_are_not_written(spark, sf):
    """They are worked out as the table is read, from the written columns, with the values of the row-wise functions."""
    from regrove.operators.features import row_features
    from regrove.sources.feature_table import MIXED, feature_table
    from regrove.sources.trips import TRIP_KEY, trips

    mixed = feature_table(spark, sf, [*TRIP_KEY, *MIXED])
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert not [c for c in MIXED if c in plan[plan.index("ReadSchema"):]]
    expected = row_features(trips(spark, sf)).select(*mixed.columns)
    assert mixed.exceptAll(expected).count() == expected.exceptAll(mixed).count() == 0
