"""Table profiles: shape, missing values, target summary, catalogue, column ranges.

Everything is one aggregate over the columns it needs; what comes out is one row per
column, so only that small result is ever sorted or moved.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from regrove.functions.nulls import clean, col, present
from regrove.operators.selection import SKETCH_ACCURACY, exact_quantiles

# Columns counted in one aggregate. Wider frames are read in column groups: the scan is
# columnar, so the bytes read stay the same and generated code stays small.
COLUMNS_PER_PASS = 100


def shape(df: DataFrame) -> DataFrame:
    """Row count and column count."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: ordinal, column, n_total, missing_count."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        group = columns[start:start + COLUMNS_PER_PASS]
        counts = df.agg(
            F.count(F.lit(1)).alias("n_total"),
            *[F.count(clean(df, c)).alias(f"n{i}") for i, c in enumerate(group)],
        )
        rows = F.array(*[
            F.struct(F.lit(start + i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"n{i}").alias("n_present"))
            for i, c in enumerate(group)
        ])
        parts.append(counts.select("n_total", F.inline(rows)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("missing_count", F.col("n_total") - F.col("n_present"))


def _percent(part: str, total: str):
    return F.try_divide(F.col(part) * 100.0, F.col(total))


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: rank, count and percent (2 decimals, half-even), most missing first."""
    columns = list(df.columns if columns is None else [c for c in columns if c in df.columns])
    if not columns:
        return df.sparkSession.createDataFrame([], "rank int, column string, missing_count long, missing_pct double")
    return (
        _null_counts(df, columns)
        .where(F.col("missing_count") > 0)
        .select(
            F.row_number().over(Window.orderBy(F.desc("missing_count"), "column")).alias("rank"),  # one row per column
            "column", "missing_count", F.bround(_percent("missing_count", "n_total"), 2).alias("missing_pct"),
        )
        .orderBy("rank")
    )


def describe_target(df: DataFrame, target: str, approx: bool = False) -> DataFrame:
    """Non-missing count, mean, exact median, sample std, min, max; `all_null` marks an empty target.

    `approx` takes the median from a sketch in the same read.
    """
    value = clean(df, target)
    stats = df.agg(
        F.count(value).alias("n_present"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        *([F.percentile_approx(value.cast("double"), 0.5, SKETCH_ACCURACY).alias("median")] if approx else []),
    )
    median = F.col("median") if approx else F.lit(exact_quantiles(df, target, [0.5])[0]).cast("double")
    return stats.select(
        "n_present", "mean", median.alias("median"), "std", "min", "max",
        (F.col("n_present") == 0).alias("all_null"),
    )


def dtype_counts(df: DataFrame) -> DataFrame:
    """Number of columns of each Spark type, most frequent first. Schema only, no scan."""
    counts: dict[str, int] = {}
    for field in df.schema.fields:
        name = field.dataType.simpleString()
        counts[name] = counts.get(name, 0) + 1
    rows = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))
    return df.sparkSession.createDataFrame(rows, "data_type string, n_columns long")


def feature_catalog(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Group, column, type and null percent (1 decimal) of the catalogued columns that exist."""
    listed = [(g, c) for g, cols in groups.items() for c in cols if c in df.columns]
    schema = "ordinal int, `group` string, column string, data_type string, null_pct double"
    if not listed:
        return df.sparkSession.createDataFrame([], schema)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    described = F.create_map(*[
        part for g, c in listed
        for part in (F.lit(c), F.struct(F.lit(g).alias("group"), F.lit(types[c]).alias("data_type")))
    ])
    return (
        _null_counts(df, [c for _, c in listed])
        .withColumn("described", described[F.col("column")])
        .select(
            "ordinal", "described.group", "column", "described.data_type",
            F.bround(_percent("missing_count", "n_total"), 1).alias("null_pct"),
        )
        .orderBy("ordinal")
    )


def column_range(df: DataFrame, column: str, approx: bool = False) -> DataFrame:
    """Distinct non-missing values, minimum and maximum of one column."""
    value = clean(df, column)
    distinct = F.approx_count_distinct(value) if approx else F.count_distinct(value)
    return df.agg(distinct.alias("n_distinct"), F.min(value).alias("min"), F.max(value).alias("max"))


def distinct_sample(df: DataFrame, columns: Iterable[str], n: int = 10) -> DataFrame:
    """The first `n` distinct values of each column, ascending, missing last.

    The columns become (ordinal, value) pairs in one scan, de-duplicated map-side and
    numbered per column. Values sort as numbers where a column is numeric, else as text.
    """
    names = [c for c in columns if c in df.columns]
    if not names:
        return df.sparkSession.createDataFrame([], "ordinal int, column string, value string")
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double")}
    cells = [
        F.struct(
            F.lit(i).alias("ordinal"), F.lit(c).alias("column"), clean(df, c).cast("string").alias("value"),
            (clean(df, c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
        )
        for i, c in enumerate(names)
    ]
    distinct = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*").distinct()
    place = F.row_number().over(Window.partitionBy("ordinal").orderBy(F.col("value").isNull(), "number", "value"))
    return distinct.withColumn("place", place).where(F.col("place") <= n).select("ordinal", "column", "value")


def feature_presence(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Which expected columns exist. Schema only, no scan."""
    rows = [(i, c, c in df.columns) for i, c in enumerate(expected)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column string, present boolean")


def with_target(df: DataFrame, target: str) -> DataFrame:
    """Rows whose target is not missing. Apply before `nan_to_null` so the null test reaches the reader."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the frame")
    return df.where(present(df, target))


def select_features(df: DataFrame, wanted: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist, in the order wanted; `also` keeps key and target columns."""
    names = [c for c in dict.fromkeys([*also, *wanted]) if c in df.columns]
    return df.select(*[col(c) for c in names])
