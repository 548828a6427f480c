"""Histories kept up by batches, stored sketches, pruned search, samples of exact size."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from regrove.operators import explore, history, increments, profile, selection, sketches
from regrove.plans import learners

KEY, ROUTE = ["k"], ["r1", "r2"]


@pytest.fixture(scope="module")
def trips(spark):
    r = random.Random(2)
    rows = []
    for i in range(900):
        at = datetime(2024, 1, 1) + timedelta(days=r.randint(0, 120), seconds=r.choice([0, 0, r.randint(0, 86399)]))
        rows.append((i, r.choice([1, 1, 1, 2, 3, None]), r.choice(["a", "a", "b", None]), r.choice([7, 8]), at if r.random() > 0.02 else None,
                     r.choice([None, r.uniform(1, 9)]), r.choice([0.0, r.uniform(1, 50)]), r.uniform(1, 60), r.choice([None, r.uniform(10, 90)])))
    schema = "k long, v int, r1 string, r2 int, ts timestamp, e double, d double, m double, s double"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz")).cache()


def in_days(trips, days, merge):
    """Rows of unknown time come first, then batches of so many days."""
    out = None
    day = F.coalesce(F.datediff(F.to_date("ts"), F.lit("2024-01-01")) / days, F.lit(-1)).cast("int")
    for number, step in enumerate(range(-1, 121 // days + 1)):
        done = merge(trips.where(day == step), number)
        out = done if out is None else out.unionByName(done)
    return out


def same(a, b, columns):
    left, right = ({r["k"]: [r[c] for c in columns] for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for k in left:
        assert left[k] == pytest.approx(right[k], nan_ok=True)


@pytest.mark.parametrize("days", [7, 40])
def test_vehicle_batches_equal_the_whole_history(trips, tmp_path, days):
    whole = history.vehicle_history(trips, "v", "ts", "e", "d")
    parts = in_days(trips, days, lambda batch, n: increments.vehicle_batch(batch, f"{tmp_path}/s", n, "v", "ts", "e", "d"))
    same(parts, whole, history.VEHICLE_COLUMNS)


def test_route_batches_equal_the_whole_history(trips, tmp_path):
    columns = ["route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count"]
    whole = history.route_history(trips, ROUTE, KEY, "ts", "e", "m", "s")
    parts = in_days(trips, 15, lambda batch, n: increments.route_batch(batch, f"{tmp_path}/s", n, ROUTE, KEY, "ts", "e", "m", "s"))
    same(parts, whole, columns)


def test_a_batch_that_is_run_again_changes_nothing(trips, tmp_path):
    early, late = trips.where("ts < '2024-02-10'"), trips.where("ts >= '2024-02-10'")
    once = []
    for _ in range(2):
        for number, batch in enumerate((early, late)):
            done = increments.vehicle_batch(batch, f"{tmp_path}/s", number, "v", "ts", "e", "d")
            routes = increments.route_batch(batch, f"{tmp_path}/s", number, ROUTE, KEY, "ts", "e", "m", "s")
        once.append((sorted(map(str, done.collect())), sorted(map(str, routes.collect()))))
    assert once[0] == once[1]


def test_old_trips_are_not_read_again(trips, tmp_path):
    """A batch reads its own trips and state of the last stretch alone."""
    increments.vehicle_batch(trips.where("ts < '2024-03-15'"), f"{tmp_path}/s", 0, "v", "ts", "e", "d")
    last = increments.vehicle_batch(trips.where("ts >= '2024-04-25'"), f"{tmp_path}/s", 1, "v", "ts", "e", "d")
    plan = last._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[(.*?)\]", plan)
    assert any("stretch" in f and "batch" in f for f in filters)


def test_sums_of_a_batch_are_dealt_evenly_to_many_tasks(spark):
    """What a task holds of a batch doesn't follow from how few bytes its shuffle has, nor from one busy vehicle."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(0).alias("v"), (F.col("id") * 300).alias("__t"),
                                      (F.col("id") % 5).cast("double").alias("e"), F.lit(2.0).alias("d"))
    sums = history._second_sums(rows, "v", "e", "d", 30 * 86400).select("stretch", "trips", F.spark_partition_id().alias("task"))
    tasks = sums.groupBy("task").agg(F.sum("trips").alias("n"), F.count_distinct("stretch").alias("stretches")).collect()
    assert sum(r["n"] for r in tasks) == 20_000
    assert len(tasks) > 8 and max(r["n"] for r in tasks) < 4_000 and max(r["stretches"] for r in tasks) <= 2


# Sketches

def test_merged_sketches_equal_whole_ones(spark):
    r = random.Random(5)
    rows = [(i % 9, r.choice([None, float("nan"), r.gauss(0, 1)]), float(r.randint(0, 3000)), None) for i in range(20_000)]
    df = spark.createDataFrame(rows, "part int, a double, b double, nothing double")
    columns = ["a", "b", "nothing"]
    parts = sketches.sketch_parts(df, columns, "part").cache()
    assert parts.count() == 27
    merged = {r["column"]: r for r in sketches.sketch_profile(sketches.merge_parts(parts)).collect()}
    whole = {r["column"]: r for r in sketches.sketch_profile(sketches.merge_parts(sketches.sketch_parts(df.withColumn("one", F.lit(1)), columns, "one"))).collect()}
    for c in columns:
        assert [merged[c][k] for k in ("n_total", "n_present", "low", "high", "n_distinct")] == [whole[c][k] for k in ("n_total", "n_present", "low", "high", "n_distinct")]
    errors = sketches.rank_errors(df, sketches.sketch_profile(sketches.merge_parts(parts)))
    assert set(errors) == {"a", "b"} and max(errors.values()) <= 0.01
    exact = df.agg(F.count_distinct("b")).first()[0]
    assert abs(merged["b"]["n_distinct"] - exact) <= 0.05 * exact and merged["nothing"]["quantiles"] is None
    some = sketches.sketch_profile(sketches.merge_parts(parts.where("part < 3")))
    assert max(sketches.rank_errors(df.where("part < 3"), some).values()) <= 0.01


def test_approximate_modes_are_near_the_exact_ones(spark):
    df = spark.range(10_001).select((F.col("id") * 7919 % 10_001).cast("double").alias("x"))
    exact, near = (selection.quantile_label(df, "x", approx=a).groupBy("label").count().orderBy("label").collect() for a in (False, True))
    assert len(near) == 4 and all(abs(a["count"] - b["count"]) <= 100 for a, b in zip(exact, near))
    target = profile.describe_target(df, "x", approx=True).first()
    assert abs(target["median"] - 5000) <= 50 and target["n_present"] == 10_001
    assert selection.quantile_label(df.where("x < 0"), "x", approx=True).count() == 0


# Samples and pruned search

@pytest.mark.parametrize("partitions", [1, 7])
def test_a_sample_of_exact_size_is_the_same_under_any_partitioning(spark, partitions):
    df = spark.range(3000).select("id", (F.col("id") % 50).cast("double").alias("x"), F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("y")).repartition(partitions)
    found = sorted(map(tuple, explore.scatter_points(df, "x", "y", key=["id"], max_points=100).collect()))
    assert len(found) == 100
    half = [explore.scatter_points(df.where(f"id % 2 = {k}"), "x", "y", key=["id"], max_points=100).collect() for k in (0, 1)]
    assert set(found) <= {tuple(p) for part in half for p in part}
    again = sorted(map(tuple, explore.scatter_points(df.repartition(3), "x", "y", key=["id"], max_points=100).collect()))
    assert again == found
    assert explore.scatter_points(df, "x", "y", key=["id"], max_points=9999).count() == df.where("y is not null").count()
    with pytest.raises(ValueError):
        explore.scatter_points(df, "x", "y", max_points=5)


def test_halving_ends_with_the_full_searchs_best(spark):
    space = {"x": learners.Float(0, 1)}
    seen = []

    def evaluate(draws, share):
        seen.append((len(draws), share))
        return [(d["x"] - 0.3) ** 2 + 0.01 * (1 - share) * (i % 2) for i, d in enumerate(draws)]

    found = learners.halving("s", space, evaluate, 25, 42)
    full = learners.search(spark, "s", space, lambda d: (d["x"] - 0.3) ** 2, 25, 42, 1)
    assert found.best[0] == full.best[0] and found.best[1] == pytest.approx(full.best[1])
    assert [n for n, _ in seen] == [25, 9, 3] and [s for _, s in seen] == [1 / 9, 1 / 3, 1.0]
    rows = found.rows()
    assert len(rows) == 25 and [sum(r == k for _, r, _ in rows) for k in range(3)] == [16, 6, 3]
