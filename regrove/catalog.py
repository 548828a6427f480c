"""Names of the feature table's columns."""

# Target, identifiers, catalogue groups, model inputs and engineered columns.
TARGET = "target_energy_consumption"

NOT_FEATURES = ["DayNum", "VehId", "Trip", "start_timestamp_ms"]

FEATURE_GROUPS = {
    "ID Features": ["DayNum", "VehId", "Trip"],
    "Target": ["target_energy_consumption"],
    "Temporal": [
        "trip_date", "start_timestamp_ms", "trip_year", "trip_month", "trip_dayofweek", "trip_hour",
        "feature_timestamp",
    ],
    "Trip Characteristics": ["distance_km", "duration_minutes", "avg_speed_kmh", "max_speed_kmh"],
    "Battery State": ["avg_battery_soc", "min_battery_soc", "max_battery_soc"],
    "Location & Elevation": [
        "avg_elevation_m", "elevation_gain_m", "origin_lat_rounded", "origin_lon_rounded",
        "dest_lat_rounded", "dest_lon_rounded",
    ],
    "Vehicle History (30 days)": [
        "vehicle_avg_efficiency_last30", "vehicle_avg_energy_last30", "vehicle_stddev_energy_last30",
        "vehicle_avg_distance_last30", "vehicle_trip_count_last30",
    ],
    "Route History (10 trips)": [
        "route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count",
    ],
}

ENGINEERED = [
    "distance_elevation_interaction", "speed_squared", "speed_per_distance", "duration_per_distance",
    "speed_variability", "elevation_gradient", "actual_speed_efficiency", "speed_efficiency_ratio",
    "battery_soc_range", "battery_usage_rate", "energy_per_km", "elevation_per_minute",
    "trip_complexity_score", "is_rush_hour", "is_weekend", "hour_sin", "hour_cos",
    "distance_category", "speed_category", "vehicle_efficiency_vs_fleet",
]

FEATURES = [
    "distance_km", "duration_minutes", "avg_speed_kmh", "max_speed_kmh",
    "avg_battery_soc", "min_battery_soc", "max_battery_soc",
    "avg_elevation_m", "elevation_gain_m",
    "origin_lat_rounded", "origin_lon_rounded", "dest_lat_rounded", "dest_lon_rounded",
    "trip_month", "trip_dayofweek", "trip_hour",
    "vehicle_avg_efficiency_last30", "vehicle_avg_energy_last30", "vehicle_stddev_energy_last30",
    "vehicle_avg_distance_last30", "vehicle_trip_count_last30",
    "route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count",
    "distance_elevation_interaction", "speed_squared", "speed_per_distance",
    "duration_per_distance", "speed_variability",
    "elevation_gradient", "actual_speed_efficiency", "speed_efficiency_ratio",
    "battery_soc_range", "battery_usage_rate", "energy_per_km",
    "elevation_per_minute", "trip_complexity_score",
    "is_rush_hour", "is_weekend", "hour_sin", "hour_cos",
    "distance_category", "speed_category",
    "vehicle_efficiency_vs_fleet",
]
