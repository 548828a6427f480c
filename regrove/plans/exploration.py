"""The profiling half of the job: every profile and exploration table of one feature table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from regrove.catalog import ENGINEERED, FEATURE_GROUPS, FEATURES, NOT_FEATURES, TARGET
from regrove.operators import explore, profile
from regrove.functions.nulls import nan_to_null

TEMPORAL = ["trip_year", "trip_month", "trip_dayofweek", "trip_hour"]
SCATTERED = ["distance_km", "avg_speed_kmh", "elevation_gain_m"]


@dataclass
class Report:
    target_status: str
    tables: dict[str, DataFrame] = field(default_factory=dict)
    exclusions: list[str] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give up what is persisted for the tables; they can still be computed."""
        for df in self.kept:
            df.unpersist()
        self.kept.clear()


def profile_table(df: DataFrame, target: str = TARGET, groups: Mapping[str, Sequence[str]] = FEATURE_GROUPS,
                  features: Sequence[str] = FEATURES, engineered: Sequence[str] = ENGINEERED,
                  date_column: str = "trip_date", temporal: Sequence[str] = TEMPORAL,
                  scattered: Sequence[str] = SCATTERED, not_features: Sequence[str] = NOT_FEATURES,
                  bins: int = 50) -> Report:
    """Small result tables by name. A table that cannot be computed (no target, no such column) is left out.

    Each table reads only its own columns of `df`; give a persisted frame if `df` is
    costly to compute. The correlation ranking is kept, as three tables derive from it.
    """
    report = Report(explore.target_status(df, target))
    t = report.tables
    t["shape"] = profile.shape(df)
    t["missing"] = profile.missing_profile(df)
    t["types"] = profile.dtype_counts(df)
    t["catalog"] = profile.feature_catalog(df, groups)
    t["presence"] = profile.feature_presence(df, engineered)
    if date_column in df.columns:
        t["date_range"] = profile.column_range(df, date_column)
    t["temporal_values"] = profile.distinct_sample(df, temporal)
    if report.target_status == "no_column":
        return report
    t["target"] = profile.describe_target(df, target)
    if report.target_status != "ok":
        return report

    usable = profile.with_target(df, target)
    t["selected_missing"] = profile.missing_profile(profile.select_features(usable, features))
    t["target_histogram"] = explore.histogram(usable, target, bins)
    for x in scattered:
        if x in df.columns:
            t[f"scatter_{x}"] = explore.scatter_bins(usable, x, target, bins)
    numeric = explore.numeric_features(df, not_features)
    if target not in numeric:
        return report
    ranked = explore.target_correlation(nan_to_null(usable), target, numeric).persist(StorageLevel.MEMORY_AND_DISK)
    report.kept.append(ranked)
    t["correlation"] = ranked
    t["correlation_top"] = explore.top_correlations(ranked, 15)
    leaks = explore.leakage_check(ranked, target)
    t["leaks"] = leaks
    report.exclusions = explore.suggested_exclusions(leaks)
    strongest = [r.feature for r in explore.top_correlations(ranked, 12).collect()]
    t["correlation_matrix"] = explore.correlation_matrix(df, strongest)
    return report


def write_report(report: Report, path: str) -> None:
    for name, table in report.tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
    report.release()
