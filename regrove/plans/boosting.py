"""Boosted regression trees with regularised second-order splits, in three shapes.

* `depth`: every node of a level splits where that pays (gamma, least child weight, L1 and L2 on leaves).
* `leaves`: the leaf with the highest gain splits next, up to a number of leaves.
* `symmetric`: one split per level for all leaves, so a row's leaf is a number of `depth` bits.

Rows are binned once and written. A pass reads them, works out where each row stands in the open tree, and adds up gradients, Hessians
and rows per node, feature and bin: one partial sum per task, merged by Spark, so what reaches the driver depends on nodes,
features and bins alone. Only the smaller child of a split is summed up; the larger one is its parent's sums less those.
A pass for best-first growth takes the children of every leaf that may split soon, so a tree needs about as many passes as levels.

Sums are whole numbers (gradients in units of a fixed fraction of the target's range), so they are equal under any partitioning, order
or repeated task, and so are the trees. Row samples and weights come from hashes of the row's key, feature subsets from hashes of
their names.

Null or NaN features stand below every border. Rows without a target are left out. An empty training set is an error.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.functions.nulls import clean
from regrove.operators.split import row_hash
from regrove.operators.metrics import regression_metrics
from regrove.plans.learners import Float, Int, LogFloat, Study, search
from regrove.session import let_workers_import, scratch_path

#: Trees whose predictions are worked out in every pass before they are written into the rows.
PENDING = 8
#: Bytes of sums that one pass brings to the driver at most; more nodes are dealt to several passes.
PASS_BYTES = 256 << 20
#: Nodes whose sums travel in one row.
SLOTS = 16
#: A gradient may grow to this many times the target's range before the whole numbers could overflow.
HEADROOM = 8
#: More than the largest weight that a bagging temperature of 1 gives.
MOST_WEIGHT = 64.0


@dataclass(frozen=True)
class Boosting:
    """Settings of one model."""

    growth: str = "depth"
    trees: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6
    max_leaves: int = 31
    min_child_weight: float = 1.0
    min_child_samples: int = 1
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    subsample: float = 1.0
    column_share: float = 1.0
    bins: int = 255
    bagging_temperature: float = 0.0
    random_strength: float = 0.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.growth not in ("depth", "leaves", "symmetric"):
            raise ValueError(f"unknown growth {self.growth!r}")
        if not 2 <= self.bins <= 255:
            raise ValueError("bins are 2 to 255")
        if not 0 <= self.bagging_temperature <= 1:
            raise ValueError("the bagging temperature is 0 to 1")


# Ranges searched per learner, under the names that the learners give them.
SPACES: dict[str, dict[str, Int | Float | LogFloat]] = {
    "boost_regularised": {
        "n_estimators": Int(100, 500),
        "max_depth": Int(3, 10),
        "learning_rate": LogFloat(0.01, 0.3),
        "subsample": Float(0.6, 1.0),
        "colsample_bytree": Float(0.6, 1.0),
        "min_child_weight": Int(1, 7),
        "gamma": Float(0, 0.5),
        "reg_alpha": Float(0, 1.0),
        "reg_lambda": Float(0, 1.0),
    },
    "boost_leaves": {
        "n_estimators": Int(100, 1000),
        "max_depth": Int(3, 12),
        "learning_rate": LogFloat(0.01, 0.3),
        "num_leaves": Int(20, 150),
        "subsample": Float(0.6, 1.0),
        "colsample_bytree": Float(0.6, 1.0),
        "min_child_samples": Int(5, 100),
        "reg_alpha": Float(0, 1.0),
        "reg_lambda": Float(0, 1.0),
    },
    "boost_symmetric": {
        "iterations": Int(100, 1000),
        "depth": Int(4, 10),
        "learning_rate": LogFloat(0.01, 0.3),
        "l2_leaf_reg": Float(1, 10),
        "border_count": Int(32, 255),
        "bagging_temperature": Float(0, 1),
        "random_strength": Float(0, 10),
    },
}
_FIELDS = {
    "n_estimators": "trees", "iterations": "trees", "depth": "max_depth", "num_leaves": "max_leaves", "colsample_bytree": "column_share",
    "l2_leaf_reg": "reg_lambda", "border_count": "bins",
}
_GROWTH = {
    "boost_regularised": Boosting("depth"),
    "boost_leaves": Boosting("leaves", max_depth=12, min_child_weight=1e-3, min_child_samples=20, reg_lambda=0.0),
    "boost_symmetric": Boosting("symmetric", min_child_weight=0.0, reg_lambda=3.0, bins=254),
}


def settings(profile: str, params: Mapping[str, float], seed: int = 42) -> Boosting:
    """A profile's settings from parameters under its learner's names."""
    if profile not in _GROWTH:
        raise ValueError(f"unknown learner profile {profile!r}")
    if unknown := set(params) - set(SPACES[profile]):
        raise ValueError(f"{profile} has no parameter {', '.join(sorted(unknown))}")
    return replace(_GROWTH[profile], seed=seed, **{_FIELDS.get(k, k): v for k, v in params.items()})


# --- trees ---------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes by number; feature -1 is a leaf. A row goes left if its bin is at most the node's."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, bin: int, gain: float) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.gain[node] = feature, bin, gain
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, 0.0), (self.gain, 0.0)):
            column.extend([empty, empty])
        return self.left[node], self.right[node]

    def at(self, binned: np.ndarray) -> np.ndarray:
        """The node in which each row ends."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.bin, self.left, self.right))
        node, row = np.zeros(len(binned), np.int64), np.arange(len(binned))
        while True:
            own = feature[node]
            inner = own >= 0
            if not inner.any():
                return node
            low = binned[row, np.maximum(own, 0)] <= cut[node]
            node = np.where(inner, np.where(low, left[node], right[node]), node)

    def predict(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.at(binned)]


@dataclass
class Symmetric:
    """One split per level; a row's leaf has the bit of every level whose border its bin is above."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=list)

    def at(self, binned: np.ndarray) -> np.ndarray:
        leaf = np.zeros(len(binned), np.int64)
        for level, (f, b) in enumerate(zip(self.feature, self.bin)):
            leaf |= (binned[:, f] > b).astype(np.int64) << level
        return leaf

    def predict(self, binned: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.at(binned)]


def binned(columns: Sequence[np.ndarray], borders: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of doubles: the number of borders below the value; NaN is bin 0."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (x, b) in enumerate(zip(columns, borders, strict=True)):
        out[:, i] = np.searchsorted(b, np.where(np.isnan(x), -np.inf, x), side="left")
    return out


@dataclass(frozen=True)
class BoostedTrees:
    """A fitted model: borders per feature, the mean it starts from, and its trees."""

    features: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    base: float
    trees: tuple[Tree | Symmetric, ...]

    def transform(self, df: DataFrame, prediction: str = "prediction") -> DataFrame:
        """`df` with the prediction, worked out batch by batch."""
        let_workers_import(df.sparkSession)
        borders, trees, base = [np.array(b) for b in self.borders], self.trees, self.base

        @F.pandas_udf("double")
        def predict(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in parts:
                rows = binned([c.to_numpy(float) for c in columns], borders)
                total = np.full(len(rows), base)
                for tree in trees:
                    total += tree.predict(rows)
                yield pd.Series(total)

        return df.withColumn(prediction, predict(*[clean(df, c).cast("double") for c in self.features]))

    def importance(self, spark: SparkSession, n: int = 20) -> DataFrame:
        """Share of all gains per feature, highest first."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[self.features[f]] += g
        every = sum(total.values()) or 1.0
        rows = sorted(((f, g / every) for f, g in total.items()), key=lambda r: (-r[1], r[0]))[:n]
        return spark.createDataFrame(rows, "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of text: a model is as large as its trees, whatever it was fitted on."""
        trees = [{"symmetric": isinstance(t, Symmetric)} | asdict(t) for t in self.trees]
        text = json.dumps({"features": self.features, "borders": self.borders, "base": self.base, "trees": trees})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedTrees:
        held = json.loads(spark.read.parquet(path).first()["model"])
        trees = tuple((Symmetric if t.pop("symmetric") else Tree)(**t) for t in held["trees"])
        return BoostedTrees(tuple(held["features"]), tuple(map(tuple, held["borders"])), held["base"], trees)


# --- rows ----------------------------------------------------------------------------------------


def find_borders(df: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to `bins` - 1 borders per feature: values at even ranks, each once, the largest left out (nothing lies above it)."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = df.agg(*[F.percentile_approx(clean(df, c).cast("double"), shares, F.lit(100 * bins)).alias(f"q{i}") for i, c in enumerate(features)],
                 *[F.max(clean(df, c).cast("double")).alias(f"z{i}") for i, c in enumerate(features)]).first()
    return [np.array(sorted({x for x in row[f"q{i}"] or () if x < row[f"z{i}"]})) for i in range(len(features))]


def draw(id: Column, tree: int) -> Column:
    """A number above 0 and below 1 from a row's hash, another one for each tree."""
    return (F.conv(F.substring(F.md5(F.concat(id, F.lit(f"|{tree}"))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def tree_features(features: Sequence[str], share: float, seed: int, tree: int) -> list[int]:
    """Numbers of the features that a tree may use: those of the least hashes."""
    order = sorted(range(len(features)), key=lambda i: hashlib.md5(f"{seed}|{tree}|{features[i]}".encode()).hexdigest())
    return sorted(order[:max(1, int(share * len(features)))])


@dataclass(frozen=True)
class _Scale:
    """Whole numbers for gradients and weights: `bits` binary places of `gradient` and `weight`."""

    bits: int
    gradient: float
    weight: float


class _Rows:
    """The binned training rows, and passes over them."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, key: Sequence[str], settings: Boosting) -> None:
        self.spark, self.settings, self.features = train.sparkSession, settings, tuple(features)
        let_workers_import(self.spark)
        known = train.withColumn("__y", clean(train, target).cast("double")).where("__y is not null")
        total = known.agg(F.count("__y").alias("n"), F.avg("__y").alias("mean"), F.min("__y").alias("low"), F.max("__y").alias("high")).first()
        if not total["n"]:
            raise ValueError("no row with a target to fit on")
        self.n, self.base = total["n"], total["mean"]
        self.borders = find_borders(known, features, settings.bins)
        widest = max(total["high"] - self.base, self.base - total["low"], 1e-300)
        self.sampled = settings.subsample < 1 or settings.bagging_temperature > 0
        weight = MOST_WEIGHT if settings.bagging_temperature > 0 else 1.0
        self.scale = _Scale(min(34, 60 - math.ceil(math.log2(self.n + 1))), 2.0 ** math.ceil(math.log2(HEADROOM * widest)), weight)
        borders, base = self.borders, self.base

        def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]
                rows = binned(columns, borders) if batch.num_rows else np.zeros((0, len(borders)), np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.full(len(rows), base)), _binary(rows)], ["id", "y", "p", "bins"])

        id = row_hash(key, settings.seed) if self.sampled else F.lit("")
        wanted = known.select(id.alias("id"), "__y", *[clean(known, c).cast("double").alias(f"c{i}") for i, c in enumerate(features)])
        self.trees: list[Tree | Symmetric] = []
        self.pending: list[Tree | Symmetric] = []
        # dealt evenly once: every pass of every tree reads these rows
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = wanted.withColumn("__at", F.xxhash64(*[c for c in wanted.columns if c != "id"])).repartition(parts, "__at").drop("__at")
        self.rows = self._written(wanted.mapInArrow(bin_rows, "id string, y double, p double, bins binary"))

    def _written(self, rows: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "binned")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def add(self, tree: Tree | Symmetric) -> None:
        """Count a finished tree in; every few trees the rows are written anew with their predictions."""
        self.trees.append(tree)
        self.pending.append(tree)
        if len(self.pending) < PENDING or len(self.trees) == self.settings.trees:
            return
        pending, width = self.pending, len(self.features)

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column(3), width)
                p = batch.column(2).to_numpy() + sum(t.predict(rows) for t in pending)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), batch.column(3)], ["id", "y", "p", "bins"])

        self.rows, self.pending = self._written(self.rows.mapInArrow(predict, self.rows.schema)), []

    def sums(self, tree: Tree | Symmetric, nodes: Sequence[int], used: Sequence[int]) -> tuple[np.ndarray, float]:
        """Whole-number sums [node, feature of `used`, bin, (gradient, Hessian, rows)], and the mean squared gradient of the rows in `nodes`."""
        number, bins, own = len(self.trees), self.settings.bins, self.settings
        pending, width, scale = self.pending, len(self.features), self.scale
        slots = np.full(max([*nodes, 0]) + 1, -1, np.int64)
        slots[list(nodes)] = np.arange(len(nodes))
        used, n_slots = list(used), len(nodes)

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(used), n_slots * bins, 3), np.int64)
            squares = [0, 0]
            held: list[tuple[np.ndarray, ...]] = []

            def empty() -> None:
                if not held:
                    return
                slot, rows, g, h = (np.concatenate([x[k] for x in held]) for k in range(4))
                held.clear()
                for i, f in enumerate(used):
                    place = slot * bins + rows[:, f]
                    # sums of whole numbers below 2^53 are exact in doubles
                    for k, weights in enumerate((g, h, None)):
                        total[i, :, k] += np.bincount(place, weights, n_slots * bins).astype(np.int64)

            size = 0
            for batch in batches:
                rows = _matrix(batch.column(2), width)
                away = batch.column(1).to_numpy() + sum(t.predict(rows) for t in pending) - batch.column(0).to_numpy()
                weight = np.ones(len(rows))
                if batch.num_columns > 3:
                    u = batch.column(3).to_numpy()
                    if own.bagging_temperature:
                        weight = (-np.log(u)) ** own.bagging_temperature
                    if own.subsample < 1:  # other digits of the same hash, so that weights and samples don't go together
                        weight = np.where((u * 65_536) % 1 < own.subsample, weight, 0.0)
                at = tree.at(rows)
                slot = np.where(at < len(slots), slots[np.minimum(at, len(slots) - 1)], -1)
                kept = np.flatnonzero((slot >= 0) & (weight > 0))
                if not len(kept):
                    continue
                away, weight = away[kept], weight[kept]
                if np.abs(away).max() > scale.gradient:
                    raise OverflowError("predictions left the range of the target; lower the learning rate")
                g = np.rint(away * weight / (scale.gradient * scale.weight) * 2.0 ** scale.bits)
                h = np.rint(weight / scale.weight * 2.0 ** scale.bits)
                squares[0] += int(np.rint((away / scale.gradient) ** 2 * 2.0 ** scale.bits).sum())
                squares[1] += len(kept)
                held.append((slot[kept], rows[kept], g, h))
                size += len(kept)
                if size >= 1 << 18:
                    empty()
                    size = 0
            empty()
            by_node = total.reshape(len(used), n_slots, bins, 3)
            for i in range(len(used)):
                for start in range(0, n_slots, SLOTS):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([start], pa.int32()), pa.array([by_node[i, start:start + SLOTS].tobytes()], pa.binary())], ["feature", "slot", "sums"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([np.array(squares, np.int64).tobytes()], pa.binary())], ["feature", "slot", "sums"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], np.ndarray] = {}
            for batch in batches:
                for f, s, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    part = np.frombuffer(raw, np.int64)
                    found[f, s] = found[f, s] + part if (f, s) in found else part
            for (f, s), part in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["feature", "slot", "sums"])

        columns = ["y", "p", "bins", *([draw(F.col("id"), number).alias("u")] if self.sampled else [])]
        schema = "feature int, slot int, sums binary"
        merged = self.rows.select(*columns).mapInArrow(add_up, schema).repartition("feature", "slot").mapInArrow(merge, schema)
        out, squared = np.zeros((n_slots, len(used), bins, 3), np.int64), 0.0
        for f, s, raw in merged.collect():
            part = np.frombuffer(raw, np.int64)
            if f < 0:
                squared = part[0] / max(1, part[1]) / 2.0 ** scale.bits * scale.gradient ** 2
            else:
                out[s:s + SLOTS, f] = part.reshape(-1, bins, 3)
        return out, squared

    def all_sums(self, tree: Tree | Symmetric, nodes: Sequence[int], used: Sequence[int]) -> dict[int, np.ndarray]:
        """Sums per node, in as many passes as their size asks for."""
        most = max(1, PASS_BYTES // (len(used) * self.settings.bins * 24))
        found = {}
        for start in range(0, len(nodes), most):
            part = nodes[start:start + most]
            found |= dict(zip(part, self.sums(tree, part, used)[0]))
        return found


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as one binary value each."""
    ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(rows.tobytes())])


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, width)


# --- splits --------------------------------------------------------------------------------------


class _Splits:
    """Gains and leaf values from whole-number sums."""

    def __init__(self, settings: Boosting, scale: _Scale) -> None:
        self.settings = settings
        unit = 2.0 ** -scale.bits
        self.unit = np.array([unit * scale.gradient * scale.weight, unit * scale.weight, 1.0])

    def _score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        g = np.maximum(np.abs(g) - self.settings.reg_alpha, 0)
        under = h + self.settings.reg_lambda
        return np.divide(g * g, under, out=np.zeros_like(g), where=under > 0)

    def gains(self, sums: np.ndarray) -> np.ndarray:
        """[node, feature, bin]: what a split above that bin gains; -inf where a child would be too small."""
        real = sums * self.unit
        left = real.cumsum(axis=2)
        every = left[:, :, -1:]
        right = every - left
        gain = 0.5 * (self._score(left[..., 0], left[..., 1]) + self._score(right[..., 0], right[..., 1]) - self._score(every[..., 0], every[..., 1]))
        if self.settings.growth == "symmetric":  # a leaf that a split leaves whole neither gains nor forbids it
            return np.where((left[..., 2] > 0) & (right[..., 2] > 0), gain, 0.0)
        least, rows = self.settings.min_child_weight, max(1, self.settings.min_child_samples)
        large = (left[..., 1] >= least) & (right[..., 1] >= least) & (left[..., 2] >= rows) & (right[..., 2] >= rows)
        return np.where(large, gain - self.settings.gamma, -np.inf)

    def value(self, sums: np.ndarray) -> float:
        """A leaf's value: the shrunk, regularised mean of what is left to explain."""
        g, h, n = (sums[0].sum(axis=0) * self.unit).tolist()
        under = h + self.settings.reg_lambda
        if not n or under <= 0:
            return 0.0
        return -self.settings.learning_rate * math.copysign(max(abs(g) - self.settings.reg_alpha, 0.0), g) / under


def _noise(settings: Boosting, spread: float, tree: int, place: int, shape: tuple[int, ...]) -> np.ndarray | float:
    """Seeded noise on gains, in units of what a split without any worth gains by chance (the mean squared gradient)."""
    if not settings.random_strength:
        return 0.0
    return settings.random_strength * spread * np.random.default_rng((settings.seed, tree, place)).standard_normal(shape)


def _best(gain: np.ndarray) -> tuple[float, int, int]:
    """Highest gain with its feature and bin, the first of equal ones."""
    place = int(np.argmax(gain))
    f, b = divmod(place, gain.shape[1])
    return float(gain[f, b]), f, b


def _children(rows: _Rows, tree: Tree, parents: Sequence[int], held: dict[int, np.ndarray], used: Sequence[int]) -> None:
    """Sums of the children of `parents`: a pass over the rows of the smaller ones, the parents' sums less those for the others."""
    pairs = []
    for node in parents:
        f, b = list(used).index(tree.feature[node]), tree.bin[node]
        low = int(held[node][f, :b + 1, 2].sum())
        small, large = (tree.left[node], tree.right[node]) if 2 * low <= int(held[node][f, :, 2].sum()) else (tree.right[node], tree.left[node])
        pairs.append((node, small, large))
    held |= rows.all_sums(tree, [small for _, small, _ in pairs], used)
    for node, small, large in pairs:
        held[large] = held[node] - held[small]
        del held[node]


def _halves(sums: np.ndarray, feature: int, bin: int) -> tuple[np.ndarray, np.ndarray]:
    """A node's sums over one feature, parted at a bin: the same totals that its children's own sums have."""
    return sums[feature:feature + 1, :bin + 1], sums[feature:feature + 1, bin + 1:]


def _grow_levels(rows: _Rows, splits: _Splits, used: list[int], number: int) -> Tree:
    own, tree = rows.settings, Tree()
    first, spread = rows.sums(tree, [0], used)
    held, frontier = {0: first[0]}, [0]
    for depth in range(own.max_depth):
        parents = []
        for node in frontier:
            gain = splits.gains(held[node][None])[0]
            best, f, b = _best(gain + _noise(own, spread, number, node, gain.shape))
            if gain[f, b] > 0:
                tree.split(node, used[f], b, float(gain[f, b]))
                parents.append(node)
            else:
                tree.value[node] = splits.value(held.pop(node))
        frontier = [child for node in parents for child in (tree.left[node], tree.right[node])]
        if not parents:
            break
        if depth + 1 < own.max_depth:
            _children(rows, tree, parents, held, used)
    if not own.max_depth:
        tree.value[0] = splits.value(held[0])
    for node in parents if own.max_depth else ():  # no pass for leaves: their totals stand in the sums of the nodes they come from
        for child, part in zip((tree.left[node], tree.right[node]), _halves(held[node], used.index(tree.feature[node]), tree.bin[node])):
            tree.value[child] = splits.value(part)
    return tree


def _grow_leaves(rows: _Rows, splits: _Splits, used: list[int], number: int) -> Tree:
    """Best-first growth. `ahead` splits every leaf where it would split, to sum up its children before they are asked for;
    the tree takes over the splits in the order of their gains."""
    own, ahead = rows.settings, Tree()
    first, spread = rows.sums(ahead, [0], used)
    held, depth = {0: first[0]}, {0: 0}
    value: dict[int, float] = {}
    queue: list[tuple[float, int]] = []
    plan: dict[int, tuple[float, int, int]] = {}

    def offer(node: int) -> None:
        value[node] = splits.value(held[node])
        if depth[node] < own.max_depth:
            gain = splits.gains(held[node][None])[0]
            best, f, b = _best(gain + _noise(own, spread, number, node, gain.shape))
            if gain[f, b] > 0:
                plan[node] = (float(gain[f, b]), used[f], b)
                heapq.heappush(queue, (-best, node))

    offer(0)
    grown, leaves, into = Tree(), 1, {0: 0}
    while queue and leaves < own.max_leaves:
        if queue[0][1] in plan and ahead.feature[queue[0][1]] < 0:
            soon = [node for _, node in heapq.nsmallest(own.max_leaves - leaves, queue) if ahead.feature[node] < 0]
            for node in soon:
                gain, f, b = plan[node]
                for child in ahead.split(node, f, b, gain):
                    depth[child] = depth[node] + 1
            _children(rows, ahead, soon, held, used)
        _, node = heapq.heappop(queue)
        gain, f, b = plan[node]
        at = into[node]
        into[ahead.left[node]], into[ahead.right[node]] = grown.split(at, f, b, gain)
        leaves += 1
        offer(ahead.left[node])
        offer(ahead.right[node])
    for node, at in into.items():
        if grown.feature[at] < 0:
            grown.value[at] = value[node]
    return grown


def _grow_symmetric(rows: _Rows, splits: _Splits, used: list[int], number: int) -> Symmetric:
    own, tree = rows.settings, Symmetric()
    first, spread = rows.sums(tree, [0], used)
    held = {0: first[0]}
    for level in range(own.max_depth):
        gain = sum(splits.gains(held[leaf][None])[0] for leaf in sorted(held))
        best, f, b = _best(np.where(gain > 0, gain + _noise(own, spread, number, level, gain.shape), -np.inf))
        if gain[f, b] <= 0:
            break
        tree.feature.append(used[f])
        tree.bin.append(b)
        tree.gain.append(float(gain[f, b]))
        if level + 1 == own.max_depth:
            tree.value = [0.0] * (2 << level)
            for leaf, sums in held.items():  # no pass for the last leaves
                tree.value[leaf], tree.value[leaf | 1 << level] = map(splits.value, _halves(sums, f, b))
            return tree
        low = {leaf: int(sums[f, :b + 1, 2].sum()) for leaf, sums in held.items()}
        small = [leaf if 2 * low[leaf] <= int(held[leaf][f, :, 2].sum()) else leaf | 1 << level for leaf in held]
        found = rows.all_sums(tree, small, used)
        for leaf in list(held):
            other = leaf | 1 << level
            if leaf in found:
                held[other] = held[leaf] - found[leaf]
                held[leaf] = found[leaf]
            else:
                held[leaf], held[other] = held[leaf] - found[other], found[other]
    tree.value = [splits.value(held[leaf]) for leaf in range(1 << len(tree.feature))]
    return tree


_GROW = {"depth": _grow_levels, "leaves": _grow_leaves, "symmetric": _grow_symmetric}


def fit_boosting(train: DataFrame, features: Sequence[str], target: str, key: Sequence[str], settings: Boosting) -> BoostedTrees:
    """Fit on the rows that have the target. `key` tells rows apart for samples and weights."""
    rows = _Rows(train, features, target, key, settings)
    splits = _Splits(settings, rows.scale)
    for number in range(settings.trees):
        used = tree_features(features, settings.column_share, settings.seed, number)
        rows.add(_GROW[settings.growth](rows, splits, used, number))
    return BoostedTrees(tuple(features), tuple(tuple(map(float, b)) for b in rows.borders), rows.base, tuple(rows.trees))


def tune_boosting(fitting: DataFrame, held: DataFrame, features: Sequence[str], target: str, key: Sequence[str], profile: str,
                  trials: int = 25, seed: int = 42, space: Mapping[str, Int | Float | LogFloat] | None = None, parallelism: int = 1) -> Study:
    """Seeded search over a profile's ranges (or `space`), each draw judged by the error on the held-out rows."""

    def evaluate(params: dict[str, float]) -> float:
        model = fit_boosting(fitting, features, target, key, settings(profile, params, seed))
        return regression_metrics(model.transform(held), target, by=None).first()["rmse"]

    return search(fitting.sparkSession, profile, SPACES[profile] if space is None else space, evaluate, trials, seed, parallelism)
