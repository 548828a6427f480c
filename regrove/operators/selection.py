"""Exact order statistics of one column without sorting the column.

Spark's `percentile` keeps every distinct value of a global aggregate in one task. Here
each wanted rank is first bracketed by two pivots taken from a mergeable sketch
(`percentile_approx`, fixed memory), the rows around the pivots are counted exactly, and
only the open interval holding the rank is looked at again. A pass keeps about
4 / accuracy of the rows. Below its accuracy the sketch is exact, so brackets shrink to
single values by themselves.

The column is read twice: once for count, bounds and first pivots, once to count around
them while the rows between them are kept. Later passes read those rows alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regrove.functions.nulls import clean

SKETCH_ACCURACY = 10_000
# Distance of the pivots from a rank, as a share of the rows; the sketch is off by half of it at most.
SLACK = 2.0 / SKETCH_ACCURACY


@dataclass
class _Bracket:
    """The values in [lo, hi]; `below` rows are smaller than lo, `inside` rows lie within."""

    rank: int
    lo: float
    hi: float
    below: int
    inside: int


def _within(v: Column, b: _Bracket) -> Column:
    return (v >= F.lit(b.lo)) & (v <= F.lit(b.hi))


def order_statistics(values: DataFrame, brackets: Sequence[_Bracket]) -> dict[int, float]:
    """Value at each bracket's rank of the single non-null column `v`. Only rows inside the brackets are read."""
    found: dict[int, float] = {}
    open_brackets = list(brackets)
    while open_brackets:
        found.update({b.rank: b.lo for b in open_brackets if b.lo == b.hi})
        open_brackets = _narrow(values, [b for b in open_brackets if b.lo < b.hi], found)
    return found


def _narrow(values: DataFrame, brackets: list[_Bracket], found: dict[int, float]) -> list[_Bracket]:
    """One sketch pass and one counting pass; settles ranks that hit a pivot, returns smaller brackets."""
    if not brackets:
        return []
    v = F.col("v")
    sketches = []
    for i, b in enumerate(brackets):
        at = (b.rank - b.below + 0.5) / b.inside
        probs = [max(0.0, at - SLACK), min(1.0, at + SLACK)]
        sketches.append(F.percentile_approx(F.when(_within(v, b), v), probs, SKETCH_ACCURACY).alias(f"p{i}"))
    pivots = values.agg(*sketches).first()

    counts = []
    for i, b in enumerate(brackets):
        a, z = pivots[i]
        inside = _within(v, b)
        middle = inside & (v > F.lit(a)) & (v < F.lit(z))
        under, over = inside & (v < F.lit(a)), inside & (v > F.lit(z))
        counts += [
            F.count_if(under).alias(f"under{i}"),
            F.count_if(inside & (v == F.lit(a))).alias(f"at_a{i}"),
            F.count_if(middle).alias(f"mid{i}"),
            F.count_if(inside & (v == F.lit(z))).alias(f"at_z{i}"),
            F.max(F.when(under, v)).alias(f"under_max{i}"),
            F.min(F.when(middle, v)).alias(f"mid_min{i}"),
            F.max(F.when(middle, v)).alias(f"mid_max{i}"),
            F.min(F.when(over, v)).alias(f"over_min{i}"),
        ]
    c = values.agg(*counts).first()

    rest = []
    for i, b in enumerate(brackets):
        a, z = pivots[i]
        under, at_a, mid = c[f"under{i}"], c[f"at_a{i}"], c[f"mid{i}"]
        at_z = c[f"at_z{i}"] if z > a else 0
        k = b.rank - b.below
        if k < under:
            rest.append(_Bracket(b.rank, b.lo, c[f"under_max{i}"], b.below, under))
        elif k < under + at_a:
            found[b.rank] = a
        elif k < under + at_a + mid:
            rest.append(_Bracket(b.rank, c[f"mid_min{i}"], c[f"mid_max{i}"], b.below + under + at_a, mid))
        elif k < under + at_a + mid + at_z:
            found[b.rank] = z
        else:
            done = under + at_a + mid + at_z
            rest.append(_Bracket(b.rank, c[f"over_min{i}"], b.hi, b.below + done, b.inside - done))
    return rest


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation; missing values are left out. Runs jobs."""
    v = F.col("v")
    values = df.select(clean(df, column).cast("double").alias("v")).where(v.isNotNull())
    around = [x for p in probs for x in (max(0.0, p - SLACK), min(1.0, p + SLACK))]
    n, lo, hi, pivots = values.agg(F.count(v), F.min(v), F.max(v), F.percentile_approx(v, around, SKETCH_ACCURACY)).first()
    if n == 0:
        return [None] * len(probs)
    spots = [p * (n - 1) for p in probs]
    pairs = [(lo if p - SLACK <= 0 else pivots[2 * i], hi if p + SLACK >= 1 else pivots[2 * i + 1]) for i, p in enumerate(probs)]

    # the second read counts around the pivots and keeps the rows between them
    counts = Observation()
    seen = values.observe(counts, *[
        c for i, (a, z) in enumerate(pairs)
        for c in (F.count_if(v < F.lit(a)).alias(f"below{i}"), F.count_if(v.between(F.lit(a), F.lit(z))).alias(f"inside{i}"))
    ])
    between = F.lit(False)
    for a, z in set(pairs):
        between = between | v.between(F.lit(a), F.lit(z))
    kept = seen.where(between).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.count()
        c, inner, outer = counts.get, {}, {}
        for i, spot in enumerate(spots):
            for rank in {floor(spot), ceil(spot)}:
                a, z, below, inside = *pairs[i], c[f"below{i}"], c[f"inside{i}"]
                if below <= rank < below + inside:
                    inner[rank] = _Bracket(rank, a, z, below, inside)
                elif rank not in inner:  # a neighbour of a pivot
                    outer[rank] = _Bracket(rank, lo, hi, 0, n)
        at = order_statistics(kept, list(inner.values()))
        at.update(order_statistics(values, [b for r, b in outer.items() if r not in at]))
    finally:
        kept.unpersist()
    out = []
    for s in spots:
        low, high = at[floor(s)], at[ceil(s)]
        out.append(low if low == high else (ceil(s) - s) * low + (s - floor(s)) * high)
    return out


def approximate_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    """Values near the quantiles, from a sketch in one read."""
    v = clean(df, column).cast("double")
    found = df.agg(F.percentile_approx(v, list(probs), SKETCH_ACCURACY)).first()[0]
    return list(found) if found else [None] * len(probs)


def quantile_label(df: DataFrame, column: str, q: int = 4, label: str = "label", approx: bool = False) -> DataFrame:
    """Adds the quantile bin 0..q-1: exact edges, right-closed, lowest edge included, equal edges merged.
    `approx` takes the edges from a sketch, in one read instead of three.

    The edges are literals, so the label itself is a row-wise expression. A constant
    column is one bin; a missing value has no label.
    """
    edges = (approximate_quantiles if approx else exact_quantiles)(df, column, [i / q for i in range(q + 1)])
    value = clean(df, column).cast("double")
    if edges[0] is None:
        return df.withColumn(label, F.lit(None).cast("int"))
    inner = sorted(set(edges))[1:-1]
    code = sum((F.when(value > F.lit(e), 1).otherwise(0) for e in inner), F.lit(0))
    return df.withColumn(label, F.when(value.isNotNull(), code).cast("int"))
