"""Features from earlier trips: rolling 30 days per vehicle, last 10 trips per route, fleet ratio.

Neither history lets one busy vehicle or route decide the size of a task. The rolling window
runs over window-long tiles, dealt by vehicle and stretch of time, the last-n means over one sort by ranges,
read a fixed number of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.functions.nulls import clean, col
from regrove.functions.times import wall_seconds
from regrove.session import let_workers_import, scratch_path

# Sorted rows that a task holds at a time, besides the few carried over from those before.
BLOCK_ROWS = 100_000

VEHICLE_COLUMNS = [
    "vehicle_avg_efficiency_last30", "vehicle_avg_energy_last30", "vehicle_stddev_energy_last30",
    "vehicle_avg_distance_last30", "vehicle_trip_count_last30",
]


def efficiency(df: DataFrame, energy: str, distance: str) -> Column:
    return F.try_divide(clean(df, energy), clean(df, distance))


def vehicle_history(df: DataFrame, vehicle: str = "VehId", ts: str = "feature_timestamp",
                    energy: str = "target_energy_consumption", distance: str = "distance_km",
                    days: int = 30) -> DataFrame:
    """Adds the vehicle's mean efficiency, energy, distance, energy std and trip count of the
    `days` days before the trip; trips of the same second do not count. A trip of unknown
    vehicle or time has no history.

    1. Trips are dealt once, by vehicle and stretch of STRETCH windows, so a vehicle's trips are cut by time. Those of a stretch's
       last window go to the next stretch, too, with nothing but what the sums need. Trips without history are dealt by all they hold.
    2. The time axis is cut into tiles as long as the window, so a window is the rest of
       the previous tile plus the start of its own. Each trip is copied to the next tile,
       and both parts are running sums - additions only, linear time. Trips keep their columns meanwhile, so nothing is joined back.
    """
    span = days * 86400
    keyed = df.select(
        col(vehicle).alias("__v"), wall_seconds(col(ts)).alias("__t"), clean(df, energy).alias("__e"), clean(df, distance).alias("__d"),
        F.struct(*[col(c) for c in df.columns]).alias("__trip"),
        F.xxhash64(*[col(f.name) for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]).alias("__any"))
    known = F.col("__v").isNotNull() & F.col("__t").isNotNull()
    tile = F.floor(F.col("__t") / span)
    own = F.when(known, F.floor(tile / STRETCH)).otherwise(F.col("__any"))
    last = known & (F.pmod(tile, F.lit(STRETCH)) == STRETCH - 1)
    spots = [F.struct(own.alias("__stretch"), F.col("__trip")), F.struct((own + 1).alias("__stretch"), F.lit(None).alias("__trip"))]
    dealt = keyed.select("__v", "__t", "__e", "__d", F.inline(F.when(last, F.array(*spots)).otherwise(F.array(spots[0])))).repartition(_tasks(df), "__v", "__stretch")

    tiled = dealt.select("__v", "__t", "__e", "__d", "__stretch", F.inline(F.array(
        F.struct(tile.alias("__tile"), F.col("__t").alias("__at"), F.lit(True).alias("__own"), F.col("__trip")),
        F.struct((tile + 1).alias("__tile"), (F.col("__t") + span).alias("__at"), F.lit(False).alias("__own"), F.lit(None).alias("__trip")),
    )))
    here = F.floor(F.col("__tile") / STRETCH) == F.col("__stretch")
    tiled = tiled.where(F.when(known, here).otherwise(F.col("__own")))

    group = Window.partitionBy("__v", "__stretch", "__tile")
    before = group.orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    since = group.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # deviations from a mean taken inside the tile keep the variance free of cancellation
    whole = group.orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tiled = tiled.withColumn("__base", F.avg("__e").over(whole))
    e, d, off = F.col("__e"), F.col("__d"), F.col("__e") - F.col("__base")
    parts = {
        "trips": (F.count, F.lit(1)), "n_eff": (F.count, F.try_divide(e, d)), "s_eff": (F.sum, F.try_divide(e, d)),
        "n_dist": (F.count, d), "s_dist": (F.sum, d), "n_e": (F.count, e), "d_e": (F.sum, off), "dd_e": (F.sum, off * off),
    }
    started = {f"__{p}_0": add(F.when(F.col("__own"), x)).over(before) for p, (add, x) in parts.items()}
    rest = {f"__{p}_1": add(F.when(~F.col("__own"), x)).over(since) for p, (add, x) in parts.items()}
    windowed = tiled.withColumns(started).withColumns(rest).where("__trip is not null")
    total = {p: F.coalesce(f"__{p}_0", F.lit(0)) + F.coalesce(f"__{p}_1", F.lit(0)) for p in parts}
    means = _means(total, F.col("__base"))
    return windowed.select("__trip.*", *[F.when(known, c).alias(name) for name, c in means.items()])


def _means(total: Mapping[str, Column], base: Column) -> dict[str, Column]:
    """What the counts and sums of a window amount to; those of the energy are of deviations from `base`."""
    variance = F.try_divide(
        F.greatest(total["dd_e"] - F.try_divide(total["d_e"] * total["d_e"], total["n_e"]), F.lit(0.0)),
        F.when(total["n_e"] > 1, total["n_e"] - 1),
    )
    return dict(zip(VEHICLE_COLUMNS, (
        F.try_divide(total["s_eff"], total["n_eff"]), base + F.try_divide(total["d_e"], total["n_e"]), F.sqrt(variance),
        F.try_divide(total["s_dist"], total["n_dist"]), total["trips"],
    )))


#: Windows in a stretch of time whose trips of a vehicle meet in one task.
STRETCH = 8

SUMS_SCHEMA = ["v", "t", "trips", "n_eff", "s_eff", "n_dist", "s_dist", "n_e", "m_e", "q_e"]


def _second_sums(keyed: DataFrame, vehicle: str, energy: str, distance: str, span: int) -> DataFrame:
    """Counts, sums and moments per (vehicle, second) and the `stretch` of `span` seconds it lies in.

    Trips are dealt by ranges of stretch, vehicle and second, so tasks are even whatever is busy, and each has few stretches to write.
    """
    known = keyed.where(col(vehicle).isNotNull() & F.col("__t").isNotNull())
    narrow = known.select(F.floor(F.col("__t") / span).alias("stretch"), col(vehicle).alias("v"), F.col("__t").alias("t"),
                          clean(keyed, energy).alias("e"), clean(keyed, distance).alias("d"))
    dealt = narrow.repartitionByRange(_tasks(keyed), "stretch", "v", "t")
    return _sums(dealt.groupBy("stretch", "v", "t"), F.try_divide("e", "d"), F.col("d"), F.col("e"))


def _tasks(df: DataFrame) -> int:
    """Tasks where sums, sorts or running sums meet: more of them than of other shuffles, so each stays small."""
    return 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sums(grouped: GroupedData, eff: Column, dist: Column, e: Column) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("trips"),
        F.count(eff).alias("n_eff"), F.sum(eff).alias("s_eff"),
        F.count(dist).alias("n_dist"), F.sum(dist).alias("s_dist"),
        F.count(e).alias("n_e"), F.avg(e).alias("m_e"), (F.var_pop(e) * F.count(e)).alias("q_e"),
    )


def _dealt(rows: DataFrame, span: int) -> DataFrame:
    """Rows with `v` and `t` dealt by vehicle and stretch; those of a stretch's last tile go to the next stretch, too."""
    tile = F.floor(F.col("t") / span)
    own = F.floor(tile / STRETCH)
    to = F.when(F.pmod(tile, F.lit(STRETCH)) == STRETCH - 1, F.array(own, own + 1)).otherwise(F.array(own))
    return rows.withColumn("stretch_of", F.explode(to)).repartition(_tasks(rows), "v", "stretch_of")


def _past(sums: DataFrame, span: int) -> DataFrame:
    """What the `fresh` (vehicle, second) pairs have behind them; a pair may stand in several rows."""
    return _past_dealt(_dealt(sums, span), span)


def _past_dealt(sums: DataFrame, span: int) -> DataFrame:
    """`_past` of sums that are dealt by vehicle and stretch."""
    tile = F.floor(F.col("t") / span)
    tiled = sums.withColumn("placed", F.explode(F.array(
        F.struct(tile.alias("tile"), F.col("t").alias("at"), F.lit(True).alias("own")),
        F.struct((tile + 1).alias("tile"), (F.col("t") + span).alias("at"), F.lit(False).alias("own")),
    ))).select("*", "placed.*").drop("placed").where(F.floor(F.col("tile") / STRETCH) == F.col("stretch_of"))

    group = Window.partitionBy("v", "stretch_of", "tile")
    # deviations from a mean taken inside the tile keep the variance free of cancellation
    tiled = tiled.withColumn("base", F.avg("m_e").over(group)).withColumns({
        "d_e": F.col("n_e") * (F.col("m_e") - F.col("base")),
        "dd_e": F.col("q_e") + F.col("n_e") * (F.col("m_e") - F.col("base")) * (F.col("m_e") - F.col("base")),
    }).withColumn("back", -F.col("at"))
    before = group.orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    since = group.orderBy("back").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    parts = ["trips", "n_eff", "s_eff", "n_dist", "s_dist", "n_e", "d_e", "dd_e"]
    started = {f"{p}_0": F.sum(F.when(F.col("own"), F.col(p))).over(before) for p in parts}
    rest = {f"{p}_1": F.sum(F.when(~F.col("own"), F.col(p))).over(since) for p in parts}
    windowed = tiled.withColumns(started).withColumns(rest).where("own and fresh")
    total = {p: F.coalesce(f"{p}_0", F.lit(0)) + F.coalesce(f"{p}_1", F.lit(0)) for p in parts}
    return windowed.select(
        F.col("v").alias("__v"), F.col("t").alias("__s"), *[c.alias(name) for name, c in _means(total, F.col("base")).items()],
    )


def _with_past(keyed: DataFrame, vehicle: str, past: DataFrame) -> DataFrame:
    return keyed.join(past, (col(vehicle) == F.col("__v")) & (F.col("__t") == F.col("__s")), "left").drop("__v", "__s")


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before; nulls are equal, so are NaNs."""
    here, before = column.slice(1), column.slice(0, max(len(column) - 1, 0))
    same = np.asarray(pc.fill_null(pc.equal(here, before), False)) | (np.asarray(pc.is_null(here)) & np.asarray(pc.is_null(before)))
    if pa.types.is_floating(column.type):
        same |= np.asarray(pc.fill_null(pc.is_nan(here), False)) & np.asarray(pc.fill_null(pc.is_nan(before), False))
    return ~same


def _rolled(group: Sequence[str], values: Sequence[str], keep: Sequence[str], names: Sequence[str], rows: int, step: int):
    """Batch function over sorted rows: place in the group and means of the `rows` rows before, as far as this partition knows them.

    It carries the last `rows` values from batch to batch, whatever a group's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[pa.Array] | None = None  # the group of the row before
        seen, head = 0, True                # its rows so far; whether it is the partition's first group
        held = [(np.zeros(rows), np.zeros(rows, bool)) for _ in values]
        for batch in (b.slice(start, step) for b in batches for start in range(0, b.num_rows, step)):
            n = batch.num_rows
            keys = [batch.column(c) for c in group]
            new = np.zeros(n, bool)
            for key, was in zip(keys, last or [k.slice(0, 0) for k in keys]):
                differs = _differs(pa.concat_arrays([was, key]))
                new[n - len(differs):] |= differs
            new[0] |= last is None
            place = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), -seen))
            first = (np.cumsum(new) == (1 if last is None else 0)) & head
            means = []
            for k, c in enumerate(values):
                column = batch.column(c)
                known = np.concatenate([held[k][1], ~np.asarray(column.is_null())])
                value = np.concatenate([held[k][0], np.asarray(column.fill_null(0.0))])
                total, count = np.zeros(n), np.zeros(n, np.int64)
                for back in range(rows, 0, -1):  # in the order of the rows
                    use = (place >= back) & known[rows - back:rows - back + n]
                    total += np.where(use, value[rows - back:rows - back + n], 0.0)
                    count += use
                means.append(pa.array(total / np.maximum(count, 1), mask=count == 0))
                held[k] = value[n:], known[n:]
            last, seen, head = [k.slice(n - 1, 1) for k in keys], int(place[-1]) + 1, bool(first[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(place.astype(np.int64)), pa.array(first), *means], list(names))

    return run


def last_rows(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], averages: Mapping[str, Column], rows: int, position: str,
              block_rows: int = BLOCK_ROWS, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds each column's mean (as double) over the `rows` rows before the current one in its group, and the
    number of all earlier rows as `position`. `order` (columns or expressions) must end in a key.

    Rows are sorted once by ranges of group and order together, so a busy group, a busy instant or a constant
    tie-break is cut wherever its rows differ. One pass over each sorted partition, `block_rows` rows at a time, works
    out places and means, and its rows are written to the shared folder, which fixes their places. Only the first
    group of a partition can go on from earlier ones: its offset, and the means of its first `rows` rows, are
    made from the partitions' edges and laid over the written rows, so these move but once.

    `finish` adds or drops columns row by row before the rows are written; it keeps `group` and what `averages` reads.
    """
    spark = df.sparkSession
    let_workers_import(spark)
    by = [col(c) for c in group]
    values = [f"__v{k}" for k in range(len(averages))]

    # 1. sorted partitions, each with what it knows by itself
    sorting = [col(c) if isinstance(c, str) else c for c in order]
    ordered = df.repartitionByRange(*by, *sorting).sortWithinPartitions(*by, *sorting)
    valued = ordered.withColumns({v: c.cast("double") for v, c in zip(values, averages.values())})
    schema = T.StructType([
        *df.schema.fields, T.StructField(position, T.LongType()), T.StructField("__head", T.BooleanType()),
        *[T.StructField(name, T.DoubleType()) for name in averages]])
    placed = valued.mapInArrow(_rolled(group, values, df.columns, schema.names, rows, block_rows), schema)
    placed = placed if finish is None else finish(placed)
    path = scratch_path(spark, "sorted")
    placed = placed.withColumn("__at", F.monotonically_increasing_id())
    placed.write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path).withColumn("__part", F.shiftright("__at", 33))

    # 2. the rows that a partition's first group has in earlier partitions: at most one row per partition
    named = [f"__g{i}" for i in range(len(group))]
    earlier = Window.partitionBy(*named).orderBy("__op").rowsBetween(Window.unboundedPreceding, -1)
    offsets = _kept(
        placed.groupBy(*[c.alias(n) for n, c in zip(named, by)], F.col("__part").alias("__op")).agg(F.count(F.lit(1)).alias("n"))
        .select("__op", F.sum("n").over(earlier).alias("__offset")).where("__offset > 0"), "offsets")

    # 3. means of the first rows of such groups, from the first and last rows of every partition
    ends = placed.groupBy(F.col("__part").alias("__op")).agg(F.max("__at").alias("__end"))
    edges = placed.select(*[c.alias(n) for n, c in zip(named, by)], "__part", "__at", "__head", *[c.cast("double").alias(v) for v, c in zip(values, averages.values())])
    edges = edges.join(F.broadcast(ends), F.col("__part") == F.col("__op")).where(
        (F.col("__at").bitwiseAND((1 << 33) - 1) < rows) | (F.col("__at") > F.col("__end") - rows))
    before = Window.partitionBy(*named).orderBy("__at").rowsBetween(-rows, -1)
    means = {f"__m{k}": F.avg(v).over(before) for k, v in enumerate(values)}
    fixed = edges.withColumns(means).where(F.col("__head") & (F.col("__at").bitwiseAND((1 << 33) - 1) < rows))
    fixed = _kept(fixed.select(F.col("__at").alias("__fixed"), *means), "edges")

    out = placed.join(F.broadcast(offsets), F.col("__head") & (F.col("__part") == F.col("__op")), "left")
    out = out.join(F.broadcast(fixed), F.col("__at") == F.col("__fixed"), "left")
    laid = {name: F.when(F.col("__fixed").isNull(), F.col(name)).otherwise(F.col(f"__m{k}")) for k, name in enumerate(averages)}
    laid[position] = F.col(position) + F.coalesce("__offset", F.lit(0).cast("long"))
    names = [c for c in placed.columns if c not in ("__head", "__at", "__part")]
    return out.select(*[laid[c].alias(c) if c in laid else col(c) for c in names])


def _kept(few: DataFrame, name: str) -> DataFrame:
    """A table of a few rows per partition, written."""
    path = scratch_path(few.sparkSession, name)
    few.coalesce(1).write.parquet(path)
    return few.sparkSession.read.schema(few.schema).parquet(path)


def route_history(df: DataFrame, route: Sequence[str], key: Sequence[str | Column], ts: str = "feature_timestamp",
                  energy: str = "target_energy_consumption", duration: str = "duration_minutes",
                  speed: str | Column = "avg_speed_kmh", trips: int = 10, block_rows: int = BLOCK_ROWS,
                  finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds the route's mean energy, duration and speed over its previous `trips` trips and the
    number of all previous trips. Trips of the same instant are ordered by `key`. `speed` is a column or an expression without NaN.
    """
    return last_rows(
        df, route, [ts, *key],
        {
            "route_avg_energy_last10": clean(df, energy),
            "route_avg_duration_last10": clean(df, duration),
            "route_avg_speed_last10": clean(df, speed) if isinstance(speed, str) else speed,
        },
        trips, "route_trip_count", block_rows, finish,
    )


def fleet_efficiency(df: DataFrame, energy: str = "target_energy_consumption", distance: str = "distance_km") -> float | None:
    """The fleet's mean efficiency. Take it from the plainest frame of the trips there is: no history changes it."""
    return df.agg(F.avg(efficiency(df, energy, distance))).first()[0]


def fleet_ratio(df: DataFrame, fleet: float | None, column: str = "vehicle_avg_efficiency_last30") -> DataFrame:
    """Adds the vehicle's recent efficiency over the fleet's."""
    return df.withColumn("vehicle_efficiency_vs_fleet", F.try_divide(clean(df, column), F.lit(fleet).cast("double")))
