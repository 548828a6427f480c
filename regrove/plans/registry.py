"""Run log, model selection and model registry, kept as append-only Parquet tables.

Any number of writers may work at a time. Every record goes into a folder of its own, so no writer's commit touches another's. A
version and an alias event are claimed first, by a file that only one writer can create: who finds it there takes the next number.
(Object stores need conditional writes for that; HDFS and local disks have exclusive creation.)
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS_SCHEMA = (
    "run_id string, run_name string, ts timestamp, params map<string,string>, metrics map<string,double>, "
    "tags map<string,string>, features array<string>, model_path string"
)
MODELS_SCHEMA = (
    "name string, version int, run_id string, tags map<string,string>, model_path string, registered_at timestamp"
)
ALIASES_SCHEMA = "name string, alias string, version int, moved_at timestamp, number int"
CHAMPION = "champion"


@dataclass
class Run:
    run_name: str | None
    params: Mapping[str, object] = field(default_factory=dict)
    metrics: Mapping[str, float | None] = field(default_factory=dict)
    tags: Mapping[str, str] = field(default_factory=dict)
    features: Sequence[str] = ()
    model_path: str | None = None
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/{uuid.uuid4().hex}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist; False if another writer has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(at.getParent())
    whole = at.makeQualified(system.getUri(), system.getWorkingDirectory())
    try:
        if whole.toUri().getScheme() == "file":  # Hadoop's local file system looks before it creates; the operating system does both at once
            return jvm.java.io.File(whole.toUri().getPath()).createNewFile()
        system.create(whole, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def claim_next(spark: SparkSession, folder: str, least: int) -> int:
    """The first free number from `least` on, claimed in `folder`."""
    number = least
    while not claim(spark, f"{folder}/{number}"):
        number += 1
    return number


def log_run(spark: SparkSession, path: str, run: Run) -> str:
    """Append one run record; returns its id."""
    row = (
        run.run_id, run.run_name, _now(), {k: str(v) for k, v in run.params.items()},
        {k: None if v is None else float(v) for k, v in run.metrics.items()}, dict(run.tags), list(run.features),
        run.model_path,
    )
    _append(spark, path, row, RUNS_SCHEMA)
    return run.run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, RUNS_SCHEMA)


def _metric(name: str) -> Column:
    return F.col("metrics")[name]


def search_runs(runs: DataFrame, order: str = "test_rmse") -> DataFrame:
    """All runs with their `rank`, best metric first, runs without the metric last. Runs of earlier sessions count."""
    place = F.row_number().over(Window.orderBy(_metric(order).asc_nulls_last(), "run_id"))  # a log holds few runs
    return runs.withColumn("rank", place).orderBy("rank")


def compare_runs(runs: DataFrame) -> DataFrame:
    """Name, RMSE and R2 of every run, with stand-ins for what a run did not record."""
    rmse = F.coalesce(_metric("test_rmse"), F.lit(float("inf")))
    listed = runs.select(
        "run_id", F.coalesce("run_name", F.lit("Unknown")).alias("run_name"), rmse.alias("test_rmse"),
        F.coalesce(_metric("test_r2"), F.lit(0.0)).alias("test_r2"),
    )
    return listed.orderBy("test_rmse", "run_id")


def best_run(runs: DataFrame) -> DataFrame:
    """The first of `search_runs`: a top-1, no full sort."""
    return runs.orderBy(_metric("test_rmse").asc_nulls_last(), "run_id").limit(1)


@dataclass(frozen=True)
class Registration:
    name: str
    version: int | None
    error: str | None = None


class Registry:
    """Versions and aliases under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.models_path = f"{root.rstrip('/')}/models"
        self.aliases_path = f"{root.rstrip('/')}/aliases"
        self.claims_path = f"{root.rstrip('/')}/claims"

    def models(self) -> DataFrame:
        return _read(self.spark, self.models_path, MODELS_SCHEMA)

    def aliases(self) -> DataFrame:
        """The current holder of every alias: the event of the highest number wins, whatever the writers' clocks say."""
        events = self.alias_events()
        return events.groupBy("name", "alias").agg(F.max_by("version", F.struct(F.coalesce("number", F.lit(0)), "moved_at", "version")).alias("version"))

    def alias_events(self) -> DataFrame:
        return _read(self.spark, self.aliases_path, ALIASES_SCHEMA)

    def register(self, name: str, run_id: str, model_path: str, tags: Mapping[str, str] | None = None) -> int:
        """Add the next version of `name`. The model must be loadable. A writer that fails after its claim leaves a gap in the versions."""
        PipelineModel.load(model_path)
        last = self.models().where(F.col("name") == name).agg(F.max("version")).first()[0]
        version = claim_next(self.spark, f"{self.claims_path}/versions/{quote(name, safe='')}", (last or 0) + 1)
        _append(self.spark, self.models_path, (name, version, run_id, dict(tags or {}), model_path, _now()), MODELS_SCHEMA)
        return version

    def set_alias(self, name: str, alias: str, version: int) -> None:
        known = self.models().where((F.col("name") == name) & (F.col("version") == version)).limit(1).count()
        if not known:
            raise ValueError(f"{name} has no version {version}")
        own = (F.col("name") == name) & (F.col("alias") == alias)
        last = self.alias_events().where(own).agg(F.max("number")).first()[0]
        number = claim_next(self.spark, f"{self.claims_path}/aliases/{quote(name, safe='')}/{quote(alias, safe='')}", (last or 0) + 1)
        _append(self.spark, self.aliases_path, (name, alias, version, _now(), number), ALIASES_SCHEMA)

    def promote(self, name: str, run: Mapping, tags: Mapping[str, str] | None = None) -> Registration:
        """Register a run's model and make it champion; a failure is reported, not raised."""
        version = None
        try:
            version = self.register(name, run["run_id"], run["model_path"], tags)
            self.set_alias(name, CHAMPION, version)
        except Exception as e:  # the comparison of runs stays valid without a registry; a version may exist without its alias
            return Registration(name, version, str(e).splitlines()[0] if str(e) else type(e).__name__)
        return Registration(name, version)

    def load(self, name: str, alias: str = CHAMPION) -> PipelineModel:
        holder = self.aliases().where((F.col("name") == name) & (F.col("alias") == alias))
        found = self.models().join(F.broadcast(holder.limit(1)), ["name", "version"]).select("model_path").first()
        if found is None:
            raise LookupError(f"{name} has no {alias}")
        return PipelineModel.load(found[0])

    def score(self, name: str, df: DataFrame, alias: str = CHAMPION) -> DataFrame:
        """Predictions of the alias holder for every row of `df`."""
        return self.load(name, alias).transform(df)


def save_model(model: PipelineModel, train: DataFrame, features: Sequence[str], path: str) -> str:
    """Save the fitted pipeline with its input schema, three example rows and the feature list."""
    spark = train.sparkSession
    model_path = f"{path.rstrip('/')}/model"
    model.write().overwrite().save(model_path)
    inputs = train.select(*features)
    inputs.limit(3).coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/example")
    described = spark.createDataFrame([(inputs.schema.json(), list(features))], "schema string, features array<string>")
    described.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/signature")
    return model_path
