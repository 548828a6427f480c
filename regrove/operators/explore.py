"""Histograms, binned scatter, correlation ranking and leakage flags."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regrove.functions.nulls import NUMERIC, clean, col, present
from regrove.operators.split import row_hash

LEAK_THRESHOLD = 0.95


def _bin_of(value: Column, lo: float, hi: float, bins: int) -> Column:
    """0-based equal-width bin, last bin closed. A range of zero width is widened by half a unit each way."""
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return F.least(F.width_bucket(value, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins)) - 1


def _bounds(df: DataFrame, *columns: str) -> list[tuple[float | None, float | None]]:
    """Min and max over the rows where every column is present: one row to the driver."""
    complete = df.where(_all_present(df, columns))
    row = complete.agg(*[
        agg for i, c in enumerate(columns)
        for agg in (F.min(col(c)).cast("double").alias(f"lo{i}"), F.max(col(c)).cast("double").alias(f"hi{i}"))
    ]).first()
    return [(row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(columns))]


def _all_present(df: DataFrame, columns: Iterable[str]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & present(df, c)
    return test


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins from min to max with edges and counts, empty bins kept, and the overall mean."""
    spark = df.sparkSession
    schema = "bin int, lo double, hi double, n long, mean double"
    (lo, hi), = _bounds(df, column)
    if lo is None:
        return spark.createDataFrame([], schema)
    value = col(column).cast("double")
    counted = df.where(present(df, column)).groupBy(_bin_of(value, lo, hi, bins).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
    )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    everything = Window.partitionBy(F.lit(0))  # at most `bins` rows
    axis = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        axis.join(counted, "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
            F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.try_divide(F.sum("total").over(everything), F.sum("n").over(everything)).alias("mean"),
        )
        .orderBy("bin")
    )


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """The data behind a scatter plot at any size: non-empty cells of a bins x bins grid."""
    schema = "x_bin int, y_bin int, n long, x_mean double, y_mean double"
    (x_lo, x_hi), (y_lo, y_hi) = _bounds(df, x, y)
    if x_lo is None or y_lo is None:
        return df.sparkSession.createDataFrame([], schema)
    xv, yv = col(x).cast("double"), col(y).cast("double")
    return (
        df.where(_all_present(df, (x, y)))
        .groupBy(
            _bin_of(xv, x_lo, x_hi, bins).cast("int").alias("x_bin"),
            _bin_of(yv, y_lo, y_hi, bins).cast("int").alias("y_bin"),
        )
        .agg(F.count(F.lit(1)).alias("n"), F.avg(xv).alias("x_mean"), F.avg(yv).alias("y_mean"))
    )


def scatter_points(df: DataFrame, x: str, y: str, fraction: float = 1.0, key: Sequence[str] = (), seed: int = 42,
                   max_points: int | None = None) -> DataFrame:
    """Complete (x, y) pairs. `fraction` thins them for a plot: rows stay whose hashed `key` falls below it, however
    they are partitioned. `max_points` keeps the rows of the lowest hashes, exactly so many where there are more: each
    task keeps as many and theirs are merged, so the sample of all is that of the parts' samples."""
    points = df.where(_all_present(df, (x, y)))
    if (fraction < 1.0 or max_points is not None) and not key:
        raise ValueError("a sample needs the columns that identify a row")
    if fraction < 1.0:
        points = points.where(F.substring(row_hash(key, seed), 1, 6) < f"{int(fraction * 16 ** 6):06x}")
    if max_points is not None:
        points = points.select(row_hash(key, seed).alias("__hash"), col(x), col(y)).orderBy("__hash", col(x), col(y)).limit(max_points)
    return points.select(col(x), col(y))


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Integer and floating columns, minus the excluded ones. Booleans, decimals and text do not count."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


_PARTIAL = (
    "i int, j int, n long, centre_x double, centre_y double, off_x double, off_y double, m_xx double, m_yy double, m_xy double, "
    "min_x double, max_x double, min_y double, max_y double"
)


def _partial_moments(columns: Sequence[str], others: Sequence[str], triangle: bool):
    """Batch function: centred pairwise moments of one task, one row per pair.

    Several hundred conditional aggregates in one plan outgrow generated code; as matrix
    products over Arrow batches the same sums took a third of the time on 41 pairs.
    """
    names = list(dict.fromkeys([*columns, *others]))
    left = [names.index(c) for c in columns]
    right = [names.index(c) for c in others]

    def run(batches):
        p, q = len(left), len(right)
        centre = np.full(len(names), np.nan)
        n, s_x, s_y, s_xx, s_yy, s_xy = (np.zeros((p, q)) for _ in range(6))
        low_x, low_y = np.full((p, q), np.inf), np.full((p, q), np.inf)
        high_x, high_y = np.full((p, q), -np.inf), np.full((p, q), -np.inf)
        for batch in batches:
            data = np.column_stack([
                np.asarray(batch.column(k).to_numpy(zero_copy_only=False), dtype=float) for k in range(len(names))
            ])
            seen = ~np.isnan(data)
            # centre each column on the first value the task meets, so sums stay small
            for k in np.flatnonzero(np.isnan(centre) & seen.any(axis=0)):
                centre[k] = data[np.argmax(seen[:, k]), k]
            shifted = np.where(seen, data - np.where(np.isnan(centre), 0.0, centre), 0.0)
            x, y = shifted[:, left], shifted[:, right]
            has_x, has_y = seen[:, left], seen[:, right]
            fx, fy = has_x.astype(float), has_y.astype(float)
            n += fx.T @ fy
            s_x += x.T @ fy
            s_y += fx.T @ y
            s_xx += (x * x).T @ fy
            s_yy += fx.T @ (y * y)
            s_xy += x.T @ y
            for j in range(q):
                both = has_x & has_y[:, j:j + 1]
                if not len(both):
                    continue
                low_x[:, j] = np.minimum(low_x[:, j], np.where(both, x, np.inf).min(axis=0))
                high_x[:, j] = np.maximum(high_x[:, j], np.where(both, x, -np.inf).max(axis=0))
                y_j = y[:, j:j + 1]
                low_y[:, j] = np.minimum(low_y[:, j], np.where(both, y_j, np.inf).min(axis=0))
                high_y[:, j] = np.maximum(high_y[:, j], np.where(both, y_j, -np.inf).max(axis=0))
        keep = n > 0
        if triangle:
            keep &= np.array(left)[:, None] <= np.array(right)[None, :]
        i, j = np.nonzero(keep)
        if not len(i):
            return
        at = n[i, j]
        c_x, c_y = centre[left][i], centre[right][j]
        d_x, d_y = s_x[i, j] / at, s_y[i, j] / at
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(at.astype(np.int64)),
                pa.array(c_x), pa.array(c_y), pa.array(d_x), pa.array(d_y),
                pa.array(np.maximum(s_xx[i, j] - at * d_x * d_x, 0.0)),
                pa.array(np.maximum(s_yy[i, j] - at * d_y * d_y, 0.0)),
                pa.array(s_xy[i, j] - at * d_x * d_y),
                pa.array(c_x + low_x[i, j]), pa.array(c_x + high_x[i, j]),
                pa.array(c_y + low_y[i, j]), pa.array(c_y + high_y[i, j]),
            ],
            names=[part.split()[0] for part in _PARTIAL.split(", ")],
        )

    return names, run


def pairwise_correlation(df: DataFrame, columns: Sequence[str], others: Sequence[str],
                         triangle: bool = False) -> DataFrame:
    """Pearson r of every (column, other) over the rows where both are present -> `i, j, n, r`.

    r is NULL for constant input. Tasks send one row per pair; the shuffle holds
    tasks x pairs rows whatever the data size.
    """
    names, run = _partial_moments(columns, others, triangle)
    wide = df.select(*[clean(df, c).cast("double").alias(f"c{k}") for k, c in enumerate(names)])
    pair = Window.partitionBy("i", "j")  # one row per task
    # task means (centre + offset) as deviations from the overall mean, measured from one of
    # the centres so that a mean far from zero costs no digits
    based = wide.mapInArrow(run, _PARTIAL).withColumns({
        "n_all": F.sum("n").over(pair),
        "x": F.col("centre_x") - F.max("centre_x").over(pair) + F.col("off_x"),
        "y": F.col("centre_y") - F.max("centre_y").over(pair) + F.col("off_y"),
    })
    placed = based.withColumns({
        a: F.col(a) - F.sum(F.col("n") * F.col(a)).over(pair) / F.col("n_all") for a in ("x", "y")
    })
    merged = placed.groupBy("i", "j").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("m_xx") + F.col("n") * F.col("x") * F.col("x")).alias("m_xx"),
        F.sum(F.col("m_yy") + F.col("n") * F.col("y") * F.col("y")).alias("m_yy"),
        F.sum(F.col("m_xy") + F.col("n") * F.col("x") * F.col("y")).alias("m_xy"),
        ((F.min("min_x") < F.max("max_x")) & (F.min("min_y") < F.max("max_y"))).alias("varies"),
    )
    r = F.try_divide(F.col("m_xy"), F.sqrt("m_xx") * F.sqrt("m_yy"))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    defined = F.col("varies") & r.isNotNull() & ~F.isnan(r)
    return merged.select("i", "j", "n", F.when(defined, bounded).alias("r"))


def _name(columns: Sequence[str], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(index) + 1)


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rank and correlation of each numeric column with the target, highest first, undefined last, target included.

    Values that differ by rounding noise alone (beyond 9 digits) rank by name. Without a
    target column, or with no target value at all, the result is empty.
    """
    spark = df.sparkSession
    if target not in numeric_features(df):
        return spark.createDataFrame([], "rank int, feature string, r double")
    columns = list(numeric_features(df) if columns is None else columns)
    if target not in columns:
        columns.append(target)
    # rows without a target take part in no pair
    usable = df.where(present(df, target))
    measured = pairwise_correlation(usable, columns, [target]).select(_name(columns, "i").alias("feature"), "n", "r")
    # a column that never meets the target has no measured row; it is listed as undefined
    listed = spark.createDataFrame([(c,) for c in columns], "feature string")
    every_feature = Window.partitionBy(F.lit(0))  # one row per column
    return (
        listed.join(measured, "feature", "left")
        .withColumn("any_pair", F.max("n").over(every_feature))
        .where(F.col("any_pair").isNotNull())
        .select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.round("r", 9).desc_nulls_last(), "feature")).alias("rank"), "feature", "r")
        .orderBy("rank")
    )


def top_correlations(ranked: DataFrame, n: int = 15) -> DataFrame:
    """The first n of `target_correlation` (the target's own row counts)."""
    return ranked.where(F.col("rank") <= n).orderBy("rank")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Symmetric correlation matrix in long form `a, b, r`: upper triangle measured once, then mirrored."""
    columns = list(columns)
    upper = pairwise_correlation(df, columns, columns, triangle=True).select(
        F.explode(F.array_distinct(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))).alias("at"),
        "r",
    ).select("at.*", "r")
    k = len(columns)
    cells = df.sparkSession.range(k * k).select(
        F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"),
    )
    return cells.join(upper, ["i", "j"], "left").select(
        _name(columns, "i").alias("a"), _name(columns, "j").alias("b"), "r",
    )


def leakage_check(ranked: DataFrame, target: str, threshold: float = LEAK_THRESHOLD) -> DataFrame:
    """Features whose |r| with the target exceeds the threshold. Reported, never removed."""
    return ranked.where((F.abs("r") > threshold) & (F.col("feature") != target))


def suggested_exclusions(leaks: DataFrame) -> list[str]:
    """Names from a leakage report, for the caller to exclude or not."""
    return [r.feature for r in leaks.orderBy("feature").collect()]


def target_status(df: DataFrame, target: str) -> str:
    """'ok', 'no_column' or 'all_null': whether target analyses can say anything. Reads at most one usable row."""
    if target not in df.columns:
        return "no_column"
    return "ok" if df.where(present(df, target)).select(col(target)).limit(1).collect() else "all_null"
