"""Tree learners, their search spaces, and seeded search."""

from __future__ import annotations

import random
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from math import exp, log
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession

from regrove.plans.trials import TRIALS_SCHEMA
from regrove.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class Int:
    low: int
    high: int

    def draw(self, rng: random.Random) -> float:
        return rng.randint(self.low, self.high)


@dataclass(frozen=True)
class Float:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return rng.uniform(self.low, self.high)


@dataclass(frozen=True)
class LogFloat:
    low: float
    high: float

    def draw(self, rng: random.Random) -> float:
        return exp(rng.uniform(log(self.low), log(self.high)))


@dataclass(frozen=True)
class Fixed:
    """A parameter that isn't searched."""

    value: float | bool

    def draw(self, rng: random.Random) -> float | bool:
        return self.value


# Ranges searched per learner. `minInfoGain` is per row here, hence the
# narrower range; parameters Spark's trees do not have are left out.
SPACES: dict[str, dict[str, Int | Float | LogFloat]] = {
    "boost_deep": {
        "maxIter": Int(100, 500),
        "maxDepth": Int(3, 10),
        "stepSize": LogFloat(0.01, 0.3),
        "subsamplingRate": Float(0.6, 1.0),
        "featureSubset": Float(0.6, 1.0),
        "minInstancesPerNode": Int(1, 7),
        "minInfoGain": Float(0.0, 0.0005),
    },
    "forest": {
        "numTrees": Int(100, 1000),
        "maxDepth": Int(3, 12),
        "subsamplingRate": Float(0.6, 1.0),
        "featureSubset": Float(0.6, 1.0),
        "minInstancesPerNode": Int(5, 100),
    },
    "boost_shallow": {
        "maxIter": Int(100, 1000),
        "maxDepth": Int(4, 10),
        "stepSize": LogFloat(0.01, 0.3),
        "maxBins": Int(33, 256),
    },
}
PROFILES = list(SPACES)

# Histogram memory per task: one pass over the rows per level of deep trees.
MEMORY_MB = 1024
# Trees of one pass with at most this many nodes are walked by every row; beyond, each row's node is kept between levels.
WALKED_NODES = 4096

_WHOLE = {"maxIter", "maxDepth", "minInstancesPerNode", "numTrees", "maxBins"}


def learner(profile: str, params: Mapping[str, float], label: str, features: str = "features",
            prediction: str = "prediction", seed: int = 42):
    """A Spark ML estimator of the profile, with exactly these parameters."""
    if profile not in SPACES:
        raise ValueError(f"unknown learner profile {profile!r}")
    forest = profile == "forest"
    settings: dict[str, object] = {}
    for name, value in params.items():
        if name == "featureSubset":
            settings["featureSubsetStrategy"] = "all" if value >= 1.0 else repr(float(value))
        elif isinstance(value, bool):
            settings[name] = value
        else:
            settings[name] = int(value) if name in _WHOLE else float(value)
    estimator = (RandomForestRegressor if forest else GBTRegressor)(
        labelCol=label, featuresCol=features, predictionCol=prediction, seed=seed, checkpointInterval=10, maxMemoryInMB=MEMORY_MB,
    ).setParams(**settings)
    nodes = (estimator.getNumTrees() if forest else 1) << estimator.getMaxDepth() + 1
    return estimator.setParams(cacheNodeIds=nodes > WALKED_NODES)


@dataclass(frozen=True)
class Study:
    """Finished search: the trials and the best of them (lowest value, then lowest number)."""

    name: str
    trials: tuple[tuple[int, float, dict[str, float]], ...]

    @property
    def best(self) -> tuple[int, float, dict[str, float]]:
        return min(self.trials, key=lambda t: (t[1], t[0]))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(self.name, n, v, {k: float(x) for k, x in p.items()}) for n, v, p in self.trials]
        return spark.createDataFrame(rows, TRIALS_SCHEMA)


def in_threads(spark: SparkSession, tasks: list[Callable[[], object]], parallelism: int) -> list:
    """Submit Spark work from several driver threads; results in order."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [task() for task in tasks]
    # wrapped one by one: threads that share one set of local properties lose each other's execution ids
    own = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda task: task(), own, chunksize=1)


def draws_of(space: Mapping[str, Int | Float | LogFloat], n: int, seed: int) -> list[dict[str, float]]:
    rng = random.Random(seed)
    return [{p: dim.draw(rng) for p, dim in space.items()} for _ in range(n)]


def search_together(spark: SparkSession, name: str, space: Mapping[str, Int | Float | LogFloat],
                    evaluate: Callable[[list[dict[str, float]]], list[float]], n: int = 25, seed: int = 42) -> Study:
    """The same draws as `search`, judged all at once: for objectives that share their scans of the rows."""
    draws = draws_of(space, n, seed)
    return Study(name, tuple((i, float(v), d) for i, (v, d) in enumerate(zip(evaluate(draws), draws, strict=True))))


def search(spark: SparkSession, name: str, space: Mapping[str, Int | Float | LogFloat],
           evaluate: Callable[[dict[str, float]], float], n: int = 25, seed: int = 42,
           parallelism: int = 4) -> Study:
    """Seeded random search. All draws are made first, so trials are the same at any parallelism."""
    ensure_checkpoint_dir(spark)
    draws = draws_of(space, n, seed)
    values = in_threads(spark, [lambda d=d: evaluate(d) for d in draws], parallelism)
    return Study(name, tuple((i, float(v), d) for i, (v, d) in enumerate(zip(values, draws))))


@dataclass(frozen=True)
class Halving:
    """A finished successive halving: per rung the trials that reached it with their values."""

    name: str
    draws: tuple[dict[str, float], ...]
    rungs: tuple[tuple[tuple[int, float], ...], ...]

    @property
    def best(self) -> tuple[int, float, dict[str, float]]:
        number, value = min(self.rungs[-1], key=lambda t: (t[1], t[0]))
        return number, value, self.draws[number]

    def rows(self) -> list[tuple[int, int, float]]:
        """Trial, the last rung it reached, its value there."""
        last = {number: (rung, value) for rung, trials in enumerate(self.rungs) for number, value in trials}
        return [(number, rung, float(value)) for number, (rung, value) in sorted(last.items())]


def halving(name: str, space: Mapping[str, Int | Float | LogFloat], evaluate: Callable[[list[dict[str, float]], float], list[float]],
            n: int = 25, seed: int = 42, shares: tuple[float, ...] = (1 / 9, 1 / 3, 1.0), keep: int = 3) -> Halving:
    """The draws of `search`, pruned: every rung judges its trials on a share of the rows and passes the best one in `keep` on.

    `evaluate(draws, share)` judges several draws on the rows whose hash lies below the share, so a rung's rows hold those of the
    rung before; the last rung sees all rows.
    """
    draws = draws_of(space, n, seed)
    alive, rungs = list(range(n)), []
    for rung, share in enumerate(shares):
        values = evaluate([draws[i] for i in alive], share)
        ranked = sorted(zip(alive, map(float, values), strict=True), key=lambda t: (t[1], t[0]))
        rungs.append(tuple(ranked))
        if rung + 1 < len(shares):
            alive = [i for i, _ in ranked[:-(-len(ranked) // keep)]]
    return Halving(name, tuple(draws), tuple(rungs))
