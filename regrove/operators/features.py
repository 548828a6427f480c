"""Row-wise trip features. Every function only adds columns: no shuffle, one codegen span.

The formulas are this library's own definitions of the columns a trip model expects.
Ratios are NULL where the divisor is zero or missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regrove.functions.nulls import clean, col

RUSH_HOURS = (7, 8, 9, 16, 17, 18)
DISTANCE_CUTS = (5.0, 15.0, 30.0)
SPEED_CUTS = (20.0, 40.0, 60.0)
COMPLEXITY_WEIGHTS = {"elevation_gradient": 0.4, "speed_variability": 0.3, "duration_per_distance": 0.3}


def time_parts(df: DataFrame, ts: str = "feature_timestamp") -> DataFrame:
    """Calendar parts of the trip start. Day of week: 1 is Sunday."""
    return df.withColumns({
        "trip_year": F.year(col(ts)),
        "trip_month": F.month(col(ts)),
        "trip_dayofweek": F.dayofweek(col(ts)),
        "trip_hour": F.hour(col(ts)),
    })


def time_patterns(df: DataFrame) -> DataFrame:
    """Cyclic hour and the two calendar flags, from `time_parts`."""
    angle = F.col("trip_hour") * (2 * pi / 24)
    return df.withColumns({
        "is_rush_hour": F.col("trip_hour").isin(*RUSH_HOURS).cast("int"),
        "is_weekend": F.col("trip_dayofweek").isin(1, 7).cast("int"),
        "hour_sin": F.sin(angle),
        "hour_cos": F.cos(angle),
    })


def rounded_coordinates(df: DataFrame, columns: Sequence[str] = ("origin_lat", "origin_lon", "dest_lat", "dest_lon"),
                        digits: int = 2) -> DataFrame:
    """Coordinates on a coarse grid, half-even."""
    return df.withColumns({f"{c}_rounded": F.bround(clean(df, c), digits) for c in columns})


def interaction_features(df: DataFrame) -> DataFrame:
    distance, speed = F.col("distance_km"), F.col("avg_speed_kmh")
    return df.withColumns({
        "distance_elevation_interaction": distance * F.col("elevation_gain_m"),
        "speed_squared": speed * speed,
        "speed_per_distance": F.try_divide(speed, distance),
        "duration_per_distance": F.try_divide(F.col("duration_minutes"), distance),
        "speed_variability": F.col("max_speed_kmh") - speed,
    })


def ratio_features(df: DataFrame) -> DataFrame:
    """Gradients and speed ratios, from `interaction_features`."""
    gain, minutes = F.col("elevation_gain_m"), F.col("duration_minutes")
    out = df.withColumns({
        "elevation_gradient": F.try_divide(gain, F.col("distance_km")),
        "actual_speed_efficiency": F.try_divide(F.col("distance_km"), minutes / 60),
        "speed_efficiency_ratio": F.try_divide(F.col("avg_speed_kmh"), F.col("max_speed_kmh")),
        "elevation_per_minute": F.try_divide(gain, minutes),
    })
    score = sum((F.col(c) * w for c, w in COMPLEXITY_WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("trip_complexity_score", score)


def battery_features(df: DataFrame, target: str = "target_energy_consumption") -> DataFrame:
    """`energy_per_km` divides the target, so it leaks it; the leakage report names it."""
    soc_range = F.col("max_battery_soc") - F.col("min_battery_soc")
    return df.withColumns({
        "battery_soc_range": soc_range,
        "battery_usage_rate": F.try_divide(soc_range, F.col("duration_minutes")),
        "energy_per_km": F.try_divide(col(target), F.col("distance_km")),
    })


def category_code(value: Column, cuts: Sequence[float]) -> Column:
    """Integer code: how many cut points the value reaches."""
    code = F.when(value.isNull(), F.lit(None).cast("int"))
    for i, cut in enumerate(sorted(cuts)):
        code = code.when(value < cut, F.lit(i))
    return code.otherwise(F.lit(len(cuts)))


def category_codes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "distance_category": category_code(clean(df, "distance_km"), DISTANCE_CUTS),
        "speed_category": category_code(clean(df, "avg_speed_kmh"), SPEED_CUTS),
    })


def row_features(df: DataFrame) -> DataFrame:
    """All row-wise groups in dependency order."""
    for step in (time_parts, time_patterns, rounded_coordinates, interaction_features,
                 ratio_features, battery_features, category_codes):
        df = step(df)
    return df
