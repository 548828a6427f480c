"""Reading feature tables and preparing schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from regrove.functions.nulls import quoted

# Where the feature table lives inside a catalog.
FEATURE_TABLE = "ml_features.ml_features_energy_prediction"
MODEL_SCHEMA = "ml_models"
DEFAULT_CATALOG = "dev"


def load(spark: SparkSession, name_or_path: str = FEATURE_TABLE, catalog: str | None = DEFAULT_CATALOG) -> DataFrame:
    """Scan one table, all columns, no filter.

    A path (anything with a slash) is read as Parquet. A `schema.table` name is placed
    in `catalog`; pass `catalog=None` to resolve it in the session's current catalog.
    """
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    parts = name_or_path.split(".")
    if catalog and len(parts) == 2:
        parts = [catalog, *parts]
    return spark.table(".".join(quoted(p) for p in parts))


def ensure_schema(spark: SparkSession, name: str) -> None:
    """Create the schema `[catalog.]schema` unless it exists."""
    parts = name.split(".")
    if not all(re.fullmatch(r"[^`./\s]+", p) for p in parts):
        raise ValueError(f"not a schema name: {name!r}")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {'.'.join(quoted(p) for p in parts)}")
