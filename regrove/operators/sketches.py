"""Stored, mergeable profiles: quantile and distinct-count sketches per part of a table.

A part (a day, say) is read once; its sketches are a few kilobytes per column and stay. A profile of any set of parts, the whole
table included, is merged from them without a second read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regrove.functions.nulls import clean, col

#: Values that a quantile sketch keeps per level: ranks are off by about 0.4 % at most.
QUANTILE_SIZE = 800
#: Binary log of a distinct-count sketch's registers: counts are off by about 1 %.
DISTINCT_BITS = 14
COLUMNS = ["n_total", "n_present", "low", "high", "quantiles", "distinct"]


def sketch_parts(df: DataFrame, columns: Sequence[str], part: str) -> DataFrame:
    """`part, column`, exact counts and bounds, and both sketches of each column's non-missing values; one read."""
    values = df.select(col(part).alias("part"), *[clean(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    aggregates = [F.count(F.lit(1)).alias("n_total")]
    for i in range(len(columns)):
        v = F.col(f"c{i}")
        aggregates += [
            F.count(v).alias(f"n{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}"), F.kll_sketch_agg_double(v, QUANTILE_SIZE).alias(f"q{i}"),
            F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), DISTINCT_BITS).alias(f"d{i}"),
        ]
    wide = values.groupBy("part").agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_present"), F.col(f"a{i}").alias("low"), F.col(f"z{i}").alias("high"),
                 F.col(f"q{i}").alias("quantiles"), F.col(f"d{i}").alias("distinct"))
        for i, c in enumerate(columns)
    ])
    return wide.select("part", "n_total", F.inline(rows)).select("part", "column", *COLUMNS)


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per column over all the parts given."""
    return parts.groupBy("column").agg(
        F.sum("n_total").alias("n_total"), F.sum("n_present").alias("n_present"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles", QUANTILE_SIZE).alias("quantiles"), F.hll_union_agg("distinct", False).alias("distinct"),
    )


def sketch_profile(merged: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """`column, n_total, n_present, low, high, quantiles` (one value per share) and `n_distinct`, from sketches alone."""
    at = F.kll_sketch_get_quantile_double("quantiles", F.array(*[F.lit(float(p)) for p in probs]))
    return merged.select(
        "column", "n_total", "n_present", "low", "high", F.when(F.col("n_present") > 0, at).alias("quantiles"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
    )


def rank_errors(df: DataFrame, profile: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> dict[str, float]:
    """The largest distance of a quantile's true rank (as a share) from the one asked for, per column; reads the table again."""
    wanted = [(r["column"], r["quantiles"]) for r in profile.collect() if r["quantiles"]]
    aggregates = []
    for i, (c, at) in enumerate(wanted):
        v = clean(df, c).cast("double")
        for k, x in enumerate(at):
            aggregates += [F.count_if(v < F.lit(x)).alias(f"b{i}_{k}"), F.count_if(v <= F.lit(x)).alias(f"u{i}_{k}")]
        aggregates.append(F.count(v).alias(f"n{i}"))
    if not aggregates:
        return {}
    row = df.agg(*aggregates).first()
    return {
        c: max(max(0.0, row[f"b{i}_{k}"] / row[f"n{i}"] - p, p - row[f"u{i}_{k}"] / row[f"n{i}"]) for k, p in enumerate(probs))
        for i, (c, _) in enumerate(wanted)
    }
