"""Trip-shaped frame over the order tables, used by the registered queries and the bench.

The values mean nothing about vehicles; the frame only has the right shape, key and
null patterns. Dimensions are attached by left join on their primary key, so a
dimension none of whose columns is wanted can be left out without changing any row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.functions.times import wall_millis

TRIP_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents"]
TARGET = "target_energy_consumption"


#: Columns of lineitem that are no trip columns by themselves.
RAW = ["l_discount", "l_tax"]
#: The trip columns that all others can be worked out from, with `RAW`.
BASE = [*TRIP_KEY[:4], "feature_timestamp", TARGET, "distance_km", "duration_minutes", "avg_battery_soc", "avg_elevation_m", "origin_nation",
        "dest_nation"]


def _expressions() -> dict[str, Column]:
    null = F.lit(None).cast("double")
    discount = F.col("l_discount")
    return {
        "l_orderkey": F.col("l_orderkey"),
        "l_linenumber": F.col("l_linenumber"),
        "l_partkey": F.col("l_partkey"),
        "l_suppkey": F.col("l_suppkey"),
        "price_cents": F.floor(F.col("l_extendedprice") * 100 + 0.5),
        "DayNum": F.unix_date(F.to_date("l_shipdate")).cast("long"),
        "VehId": F.col("l_suppkey"),
        "Trip": F.col("l_orderkey"),
        TARGET: F.col("l_extendedprice"),
        "trip_date": F.to_date("l_shipdate"),
        "start_timestamp_ms": wall_millis(F.col("l_shipdate")),
        "feature_timestamp": F.col("l_shipdate"),
        "distance_km": F.col("l_quantity"),
        "duration_minutes": F.col("o_totalprice") / 1000,
        "avg_speed_kmh": average_speed(),
        "max_speed_kmh": discount * 1000 + F.col("l_tax") * 100,
        "avg_battery_soc": F.col("c_acctbal"),
        "min_battery_soc": F.col("c_acctbal") - discount * 1000,
        "max_battery_soc": F.col("c_acctbal") + F.col("l_tax") * 1000,
        "avg_elevation_m": F.col("s_acctbal"),
        "elevation_gain_m": F.when(F.col("l_linenumber") == 1, null).otherwise(F.col("l_tax") * 100),
        "origin_nation": F.col("s_nationkey"),
        "dest_nation": F.col("c_nationkey"),
        "origin_lat": F.col("s_acctbal") / 173.21,
        "origin_lon": F.col("s_nationkey") * 13.3 - 160,
        "dest_lat": F.col("c_acctbal") / 173.21,
        "dest_lon": F.col("c_nationkey") * 13.3 - 160,
        "l_discount": discount,
        "l_tax": F.col("l_tax"),
        "planted_target": (
            F.col("l_quantity") * 3 + discount * 100
            + F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 17, F.lit(101)) / 1010
        ),
    }


# Which dimension tables a column needs besides lineitem.
_NEEDS = {
    "duration_minutes": {"orders"},
    "avg_battery_soc": {"orders", "customer"},
    "min_battery_soc": {"orders", "customer"},
    "max_battery_soc": {"orders", "customer"},
    "dest_nation": {"orders", "customer"},
    "dest_lat": {"orders", "customer"},
    "dest_lon": {"orders", "customer"},
    "avg_elevation_m": {"supplier"},
    "origin_nation": {"supplier"},
    "origin_lat": {"supplier"},
    "origin_lon": {"supplier"},
}


def trips(spark: SparkSession, sf_dir: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The trip frame, restricted to `columns` (default all), touching only the tables they need."""
    exprs = _expressions()
    wanted = [c for c in exprs if c not in RAW] if columns is None else list(dict.fromkeys(columns))
    needed: set[str] = set().union(*[_NEEDS.get(c, set()) for c in wanted])

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    df = read("lineitem")
    if "orders" in needed:
        # the two smaller tables meet first, so the fact table is shuffled once, by order
        orders = read("orders").select("o_orderkey", "o_custkey", "o_totalprice")
        if "customer" in needed:
            customer = read("customer").select("c_custkey", "c_nationkey", "c_acctbal")
            orders = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
    if "supplier" in needed:
        supplier = read("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
        df = df.join(supplier, df.l_suppkey == supplier.s_suppkey, "left")
    return df.select(*[exprs[c].alias(c) for c in wanted])


def price_cents() -> Column:
    """The last part of the key, worked out from `BASE`."""
    return F.floor(F.col(TARGET) * 100 + 0.5)


def average_speed() -> Column:
    """Worked out from `RAW`."""
    discount = F.col("l_discount")
    return F.when(discount == 0, F.lit(None).cast("double")).otherwise(discount * 1000)


def widened(base: DataFrame) -> DataFrame:
    """All trip columns in the order of `trips`, those that `base` lacks worked out from `BASE` and `RAW`, then whatever else it has."""
    exprs = {c: e for c, e in _expressions().items() if c not in RAW}
    raw = base.withColumns({
        "l_shipdate": F.col("feature_timestamp"), "l_extendedprice": F.col(TARGET), "l_quantity": F.col("distance_km"), "c_acctbal": F.col("avg_battery_soc"),
        "s_acctbal": F.col("avg_elevation_m"), "s_nationkey": F.col("origin_nation"), "c_nationkey": F.col("dest_nation"),
    })
    rest = [c for c in base.columns if c not in exprs]
    return raw.select(*[F.col(c) if c in base.columns else e.alias(c) for c, e in exprs.items()], *rest)
