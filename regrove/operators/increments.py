"""Histories kept up by batches: a batch of new trips is merged into stored state, old trips aren't read again.

Batches are numbered from 0 and hold the trips of a stretch of time (a day, say): none is earlier than those of the batches before, and
those of one instant are in one batch. Each batch writes a state folder of its own, so a batch that failed half-way is just run again.

* Vehicles: sums per (vehicle, second), laid out by window-long stretches of time; a batch reads its own stretch and the one before.
* Routes: the number of trips and the last ones of every route; a batch reads what the batch before it left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.functions.nulls import clean, col
from regrove.functions.times import wall_seconds
from regrove.operators.history import BLOCK_ROWS, _past, _second_sums, _with_past, last_rows

RING = "array<struct<e:double,d:double,s:double>>"


def vehicle_batch(batch: DataFrame, root: str, number: int, vehicle: str = "VehId", ts: str = "feature_timestamp",
                  energy: str = "target_energy_consumption", distance: str = "distance_km", days: int = 30) -> DataFrame:
    """`batch` with the features of `vehicle_history`, from the batch and the sums that earlier ones left under `root`."""
    spark, span = batch.sparkSession, days * 86400
    keyed = batch.withColumn("__t", wall_seconds(col(ts)))
    own_path = f"{root.rstrip('/')}/sums/batch={number}"
    sums = _second_sums(keyed, vehicle, energy, distance, span)
    sums.write.mode("overwrite").partitionBy("stretch").parquet(own_path)
    fresh = spark.read.schema(sums.schema).parquet(own_path)
    first = fresh.agg(F.min("stretch")).first()[0]
    every = fresh.withColumn("fresh", F.lit(True))
    if number and first is not None:
        with_batch = T.StructType([*sums.schema.fields, T.StructField("batch", T.IntegerType())])
        old = spark.read.schema(with_batch).option("basePath", f"{root.rstrip('/')}/sums").parquet(f"{root.rstrip('/')}/sums")
        # partition columns: whole folders are left out
        old = old.where((F.col("batch") < number) & (F.col("stretch") >= first - 1))
        every = every.unionByName(old.drop("batch").withColumn("fresh", F.lit(False)))
    return _with_past(keyed, vehicle, _past(every.drop("stretch"), span)).drop("__t")


def route_batch(batch: DataFrame, root: str, number: int, route: Sequence[str], key: Sequence[str], ts: str = "feature_timestamp",
                energy: str = "target_energy_consumption", duration: str = "duration_minutes", speed: str = "avg_speed_kmh",
                trips: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`batch` with the features of `route_history`, from the batch and the last trips that the batch before left under `root`."""
    spark = batch.sparkSession
    names = [f"__r{i}" for i in range(len(route))]
    values = {"__e": clean(batch, energy).cast("double"), "__d": clean(batch, duration).cast("double"), "__s": clean(batch, speed).cast("double")}
    rows = batch.withColumns({n: col(c) for n, c in zip(names, route)} | values).withColumn("__seq", F.lit(0))
    left = _left(spark, root, number - 1, rows, names)
    # the last trips of a route come first, as rows without anything else; they are counted, used and dropped
    ring = left.select(*names, F.posexplode("ring").alias("at", "x")).select(
        *names, F.col("x.e").alias("__e"), F.col("x.d").alias("__d"), F.col("x.s").alias("__s"), (F.col("at") - trips).cast("int").alias("__seq"))
    every = rows.unionByName(ring, allowMissingColumns=True)
    placed = last_rows(
        every, names, ["__seq", ts, *key],
        {"route_avg_energy_last10": F.col("__e"), "route_avg_duration_last10": F.col("__d"), "route_avg_speed_last10": F.col("__s")},
        trips, "__place", block_rows,
    )
    path = f"{root.rstrip('/')}/routes/batch={number}"
    known = left.select(*[F.col(n).alias(f"{n}_k") for n in names], F.col("n").alias("__before"), F.size("ring").alias("__held"))
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}_k"))
    counted = placed.join(known, same, "left").withColumn(
        "route_trip_count", F.col("__place") - F.coalesce("__held", F.lit(0)) + F.coalesce("__before", F.lit(0).cast("long")))
    totals = every.groupBy(*[F.col(n).alias(f"{n}_t") for n in names]).agg(F.count(F.lit(1)).alias("__rows"))
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_t"))
    last = placed.join(totals, match).where(F.col("__place") >= F.col("__rows") - trips)
    held = last.groupBy(*names).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("__place", "__e", "__d", "__s"))),  # at most `trips` rows
                    lambda x: F.struct(x["__e"].alias("e"), x["__d"].alias("d"), x["__s"].alias("s"))).alias("ring"),
        F.max("__place").alias("__last"),
    )
    same_held = F.lit(True)
    for n in names:
        same_held = same_held & F.col(n).eqNullSafe(F.col(f"{n}_k"))
    state = held.join(known, same_held, "left").select(
        *names, (F.col("__last") + 1 - F.coalesce("__held", F.lit(0)) + F.coalesce("__before", F.lit(0).cast("long"))).alias("n"), F.col("ring").cast(RING).alias("ring"))
    state.write.mode("overwrite").parquet(path)
    return counted.where("__seq = 0").select(
        *[col(c) for c in batch.columns], "route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count")


def _left(spark: SparkSession, root: str, number: int, rows: DataFrame, names: list[str]) -> DataFrame:
    """Per route its number of trips and the last ones, as batch `number` left them."""
    routes = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    schema = f"{routes}, n bigint, ring {RING}"
    if number < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/routes/batch={number}")
