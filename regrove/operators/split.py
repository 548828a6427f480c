"""Exact, seeded partition of rows into parts of given sizes, with no shuffle of the rows.

Rows are ordered by md5(seed, key). Cutting that order into parts only needs the hash at
each cut, not the rank of every row. Hashes are even, so a cut lies near its share of the
hash range: after a count of each stratum, one pass hashes the rows, counts those between the
windows around the cuts and, hash by hash, those in them (some sixteen standard deviations,
so about the root of the rows). A cut outside its window - many rows with one key - is found by
counting hash prefixes (map-side, 4,096 groups per stratum), keeping the one prefix that holds
it, and counting its next digits until the prefix holds a single hash. The part of a row is then
a row-wise comparison, so the result depends on neither the partitioning nor on any re-run of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil, floor, sqrt

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.functions.nulls import clean, col

_DIGITS = 3          # hex digits counted per pass
MAX_STRATA = 1_000   # classes; 4,096 counts each are summed up in Spark
_NEAR = 8            # hex digits of the bounds of a window around a cut
_MAX_WINDOWS = 64    # windows that one expression names; beyond, prefixes are counted


def row_hash(key: Sequence[str], seed: int | str) -> Column:
    """32 hex digits; the key text joined by '|'. Keep raw doubles out of the key: use integer units."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def largest_remainder(sizes: Mapping[object, int], total: int) -> dict[object, int]:
    """Share `total` over the strata in proportion to their sizes."""
    n = sum(sizes.values())
    if n == 0:
        return {s: 0 for s in sizes}
    exact = {s: divmod(total * size, n) for s, size in sizes.items()}
    shares = {s: whole for s, (whole, _) in exact.items()}
    left = total - sum(shares.values())
    for s in sorted(exact, key=lambda s: (-exact[s][1], str(s)))[:left]:
        shares[s] += 1
    return shares


@dataclass
class _Cut:
    """The rows ranked up to `rank` in a stratum end at `hash`.

    `before` rows have a smaller hash and `equal` rows have this one, so the cut runs
    through a group of equal hashes when rank < before + equal.
    """

    stratum: object
    rank: int
    hash: str = ""
    before: int = 0
    equal: int = 0

    @property
    def torn(self) -> bool:
        return self.rank < self.before + self.equal


def _counts(rows: DataFrame, depth: int) -> DataFrame:
    """Rows per longer prefix, under the prefix already fixed: map-side sums. Under a fixed prefix the least and greatest hash, too;
    at depth 0 they would make Spark sort all rows, because strings have no place in its hash aggregates.
    """
    fixed, prefix = F.substring("h", 1, depth).alias("under"), F.substring("h", 1, depth + _DIGITS).alias("p")
    bounds = [F.min("h").alias("least"), F.max("h").alias("greatest")] if depth else []
    return rows.groupBy("stratum", fixed, prefix).agg(F.count(F.lit(1)).alias("n"), *bounds)


def _sizes(counts: DataFrame) -> dict[object, int]:
    found = counts.groupBy("stratum").agg(F.sum("n").alias("n")).limit(MAX_STRATA + 1).collect()
    if len(found) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata: a split needs a label of few classes")
    return {r["stratum"]: r["n"] for r in found}


def _narrow(counts: DataFrame, cuts: list[_Cut]) -> None:
    """Move each cut on to the longer prefix that holds its rank. The counts are summed up in Spark; a row per cut comes back."""
    schema = T.StructType([
        T.StructField("cut", T.IntegerType()), T.StructField("s", counts.schema["stratum"].dataType), T.StructField("u", T.StringType()), T.StructField("need", T.LongType())])
    wanted = counts.sparkSession.createDataFrame([(i, c.stratum, c.hash, c.rank - c.before) for i, c in enumerate(cuts)], schema)
    summed = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("stratum", "under").orderBy("p")))
    here = F.col("stratum").eqNullSafe(F.col("s")) & (F.col("under") == F.col("u")) & (F.col("need") <= F.col("upto")) & (F.col("need") > F.col("upto") - F.col("n"))
    bounds = [c for c in ("least", "greatest") if c in counts.columns]
    for r in summed.join(F.broadcast(wanted), here).select("cut", "p", "n", "upto", *bounds).collect():
        c = cuts[r["cut"]]
        c.hash, c.before = r["p"], c.before + r["upto"] - r["n"]
        if bounds and r["least"] == r["greatest"]:
            c.hash, c.equal = r["least"], r["n"]


def _find_cuts(rows: DataFrame, first: DataFrame, wanted: Sequence[tuple[object, int]]) -> list[_Cut]:
    """Locate each (stratum, rank >= 1) in the frame `stratum, h`, whose counts at depth 0 are given."""
    cuts = [_Cut(s, r) for s, r in wanted]
    open_, depth, counts, kept = cuts, 0, first, None
    try:
        while open_:
            _narrow(counts, open_)
            open_, depth = [c for c in open_ if not c.equal], depth + _DIGITS
            if not open_:
                break
            # one hash per row; rows of other strata under the same prefix do no harm
            under = (rows if kept is None else kept).where(F.substring("h", 1, depth).isin(sorted({c.hash for c in open_})))
            if kept is None:
                kept = under = under.persist(StorageLevel.MEMORY_AND_DISK)
            counts = _counts(under, depth)
    finally:
        if kept is not None:
            kept.unpersist()
    return cuts


Sizes = dict[object, int]
Store = Callable[[DataFrame], DataFrame]


def _windows(wanted: Sequence[tuple[object, int]], sizes: Sizes) -> dict[object, list[tuple[str, str | None]]]:
    """Per stratum the ranges of hashes [low, high) in which its cuts are expected, in order and apart; None is beyond every hash."""
    whole, found = 16 ** _NEAR, {}
    for s, rank in sorted(wanted, key=lambda w: w[1]):
        n, spans = sizes[s], found.setdefault(s, [])
        p = rank / n
        slack = 8 * sqrt((p * (1 - p) + 1 / n) / n) + 8 / n
        low, high = max(0, floor((p - slack) * whole)), ceil((p + slack) * whole) + 1
        if spans and low <= spans[-1][1]:
            low = spans.pop()[0]
        spans.append((low, high))
    return {s: [(f"{a:0{_NEAR}x}", f"{b:0{_NEAR}x}" if b < whole else None) for a, b in spans] for s, spans in found.items()}


def _place(stratum: Column, h: Column, windows: Mapping[object, Sequence[tuple[str, str | None]]]) -> Column:
    """The hash of a row in a window, of any other the bound before it: it lies on the same side of every cut in a window as the hash."""
    place = F.lit("")
    for s, spans in windows.items():
        own = F.lit("")
        for low, high in spans:
            inside = h if high is None else F.when(h < F.lit(high), h).otherwise(F.lit(high))
            own = F.when(h >= F.lit(low), inside).otherwise(own)
        place = F.when(stratum.eqNullSafe(F.lit(s)), own).otherwise(place)
    return place


def _near(rows: DataFrame, windows: Mapping[object, Sequence[tuple[str, str | None]]]) -> DataFrame:
    """Counts like `_counts` of the rows' places."""
    return _by_place(rows.select("stratum", _place(F.col("stratum"), F.col("h"), windows).alias("p")))


def _by_place(places: DataFrame) -> DataFrame:
    counts = places.groupBy("stratum", F.lit("").alias("under"), "p").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"least": F.col("p"), "greatest": F.when(F.length("p") > _NEAR, F.col("p"))})


def _locate(rows: DataFrame, wanted: Sequence[tuple[object, int]], sizes: Sizes) -> list[_Cut]:
    """The cuts in the frame `stratum, h`: from one pass that hashes the rows if they are where even hashes have them."""
    cuts, lost = [_Cut(s, r) for s, r in wanted], list(wanted)
    if wanted and len(wanted) <= _MAX_WINDOWS:
        _narrow(_near(rows, _windows(wanted, sizes)), cuts)
        lost = [(c.stratum, c.rank) for c in cuts if not c.equal]
    if not lost:
        return cuts
    first = _counts(rows, 0).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return [c for c in cuts if c.equal] + _find_cuts(rows, first, lost)
    finally:
        first.unpersist()


def assign_parts(df: DataFrame, key: Sequence[str], plan: Callable[[Sizes], Mapping[object, Sequence[int]]],
                 seed: int | str, stratum: Column | None = None, part: str = "part", store: Store | None = None) -> DataFrame:
    """Adds the integer column `part`: in each stratum the first rows in hash order get 0, the next 1, and so on.

    `plan` turns the rows per stratum into the part sizes per stratum, which must add up
    to them. Rows with equal keys are ordered by a hash of all their columns. Where a cut
    runs through rows that are equal in every column, those copies are counted and
    written out again on both sides of it.

    `store` writes or persists the rows and returns them as kept, without columns of `df` that nobody will read. The rows are then
    hashed once, on their way there, because their places are kept with them; where a cut is outside its window, `store` is called again.
    """
    stratum = F.lit(0) if stratum is None else stratum
    counts = _sizes(df.select(stratum.alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n")))
    sizes, wanted = plan(counts), []
    for s, parts in sizes.items():
        ends = dict.fromkeys(sum(parts[:i]) for i in range(1, len(parts)))
        wanted += [(s, e) for e in ends if e > 0]

    def coded(hashed: DataFrame, cuts: list[_Cut]) -> DataFrame:
        at = {(c.stratum, c.rank): c for c in cuts}
        code = F.lit(None).cast("int")
        for s, parts in sizes.items():
            beyond = F.lit(0)
            total = 0
            for size in parts[:-1]:
                total += size
                past = F.lit(1) if total == 0 else F.when(F.col("__h") > F.lit(at[(s, total)].hash), 1).otherwise(0)
                beyond = beyond + past
            code = F.when(F.col("__s").eqNullSafe(F.lit(s)), beyond).otherwise(code)
        return hashed.withColumn(part, code.cast("int")).drop("__s", "__h")

    order = row_hash(key, seed)
    if store and wanted and len(wanted) <= _MAX_WINDOWS:
        hashed = df.withColumns({"__s": stratum, "__h": order})
        kept = store(hashed.withColumn("__h", _place(F.col("__s"), F.col("__h"), _windows(wanted, counts))))
        cuts = [_Cut(s, r) for s, r in wanted]
        _narrow(_by_place(kept.select(F.col("__s").alias("stratum"), F.col("__h").alias("p"))), cuts)
        if all(c.equal and not c.torn for c in cuts):
            return coded(kept, cuts)

    def locate(order: Column) -> list[_Cut]:
        return _locate(df.select(stratum.alias("stratum"), order.alias("h")), wanted, counts)

    cuts = locate(order)
    if any(c.torn for c in cuts):
        order = F.concat(order, F.md5(F.to_json(F.struct(*[col(c) for c in df.columns]))))
        cuts = locate(order)
    hashed = df.withColumns({"__s": stratum, "__h": order})

    torn = {(c.stratum, c.hash): c for c in cuts if c.torn}
    if not torn:
        out = coded(hashed, cuts)
    else:
        in_torn = F.lit(False)
        for s, h in torn:
            in_torn = in_torn | (F.col("__s").eqNullSafe(F.lit(s)) & (F.col("__h") == h))
        out = coded(hashed.where(~in_torn), cuts).unionByName(_rewrite_copies(hashed.where(in_torn), df.columns, torn, sizes, part))
    return store(out) if store else out


def _rewrite_copies(copies: DataFrame, columns: Sequence[str], torn: Mapping[tuple, _Cut],
                    sizes: Mapping[object, Sequence[int]], part: str) -> DataFrame:
    """Copies of one row, collapsed to a count and generated again with their parts by rank."""
    spark = copies.sparkSession
    group = F.lit(None).cast("int")
    numbered = None
    for g, ((s, h), c) in enumerate(torn.items()):
        group = F.when(F.col("__s").eqNullSafe(F.lit(s)) & (F.col("__h") == h), F.lit(g)).otherwise(group)
        rank = F.col("id") + F.lit(c.before)
        code, total = F.lit(0), 0
        for size in sizes[s][:-1]:
            total += size
            code = code + F.when(rank >= total, 1).otherwise(0)
        one = spark.range(c.equal).select(F.lit(g).alias("__g"), code.cast("int").alias(part))
        numbered = one if numbered is None else numbered.unionByName(one)
    # one row per torn group, at most one group per cut
    single = copies.withColumn("__g", group).groupBy("__g", *columns).agg(F.count(F.lit(1)).alias("__m"))
    return numbered.join(F.broadcast(single), "__g").select(*[col(c) for c in columns], part)


def stratified_split(df: DataFrame, label: str, key: Sequence[str], test: float = 0.2, seed: int = 42,
                     split: str = "split", store: Store | None = None) -> DataFrame:
    """Adds `split` ('train' / 'test'): ceil(test * n) test rows, shared over the labels by largest remainder.

    `label` is a small set of classes (quantile bins). A class with one row stays in train. `store` as in `assign_parts`.
    """
    def plan(sizes: Sizes) -> dict[object, list[int]]:
        n_test = ceil(round(test * sum(sizes.values()), 9))
        eligible = {s: n for s, n in sizes.items() if n > 1}
        shares = largest_remainder(eligible, min(n_test, sum(eligible.values())))
        return {s: [shares.get(s, 0), n - shares.get(s, 0)] for s, n in sizes.items()}

    assigned = assign_parts(df, key, plan, seed, col(label), "__part", store)
    return assigned.withColumn(split, F.when(F.col("__part") == 0, "test").otherwise("train")).drop("__part")


def kfold(df: DataFrame, key: Sequence[str], k: int = 5, seed: int | str = 42, fold: str = "fold", store: Store | None = None) -> DataFrame:
    """Adds `fold` 0..k-1: shuffled by hash, sizes differ by at most one, the larger folds first. `store` as in `assign_parts`."""
    def plan(sizes: Sizes) -> dict[object, list[int]]:
        return {s: [n // k + (1 if i < n % k else 0) for i in range(k)] for s, n in sizes.items()}

    return assign_parts(df, key, plan, seed, None, fold, store)


def split_summary(df: DataFrame, target: str, split: str = "split") -> DataFrame:
    """Rows, percent of all rows, target mean and sample std per side."""
    y = clean(df, target)
    sides = df.groupBy(col(split).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"),
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # two rows
    return sides.select("split", "n", (F.col("n") * 100.0 / total).alias("pct"), "target_mean", "target_std")
