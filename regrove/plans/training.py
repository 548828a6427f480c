"""The whole job: split, tune, refit, stack, compare, promote the champion.

One frame, cut down to key, target and features, is split once and kept for all fits.
Only metrics, tuned parameters and model files leave the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regrove.catalog import FEATURES, TARGET
from regrove.functions.nulls import nan_to_null
from regrove.operators.metrics import fold_summary, regression_metrics
from regrove.operators.prep import fit_prep
from regrove.operators.profile import select_features, with_target
from regrove.operators.selection import quantile_label
from regrove.operators.split import kfold, stratified_split
from regrove.plans import registry
from regrove.plans.learners import PROFILES, SPACES, Study, draws_of, search
from regrove.plans.modelling import (
    VECTOR, WEIGHT, Base, condensed, cross_validate, fit_single, fit_stack, importance, repeated, rmse, spread, vectors,
)
from regrove.plans.trials import param_importance, trial_history, trial_points, trial_summary
from regrove.session import ensure_checkpoint_dir
from regrove.sources.tables import DEFAULT_CATALOG, MODEL_SCHEMA, ensure_schema

# Names the runs are logged and the model is registered under.
ENSEMBLE_RUN = "Ensemble_Stacking_CV"
MODEL_NAME = "battery_energy_prediction"


@dataclass(frozen=True)
class Settings:
    root: str
    key: Sequence[str]
    target: str = TARGET
    features: Sequence[str] = tuple(FEATURES)
    exclude: Sequence[str] = ()      # e.g. what the leakage report suggests
    catalog: str = DEFAULT_CATALOG   # models of one catalog don't share a name with another's
    model_name: str = MODEL_NAME
    source_table: str = "unknown"
    test: float = 0.2
    seed: int = 42
    trials: int = 25
    folds: int = 5
    alpha: float = 1.0
    parallelism: int = 4
    # search space per profile; a cheaper job passes a smaller one
    spaces: Mapping[str, Mapping] = field(default_factory=lambda: SPACES)
    profiles: Sequence[str] = tuple(PROFILES)
    # 'validation' tunes on a fold of the training rows; 'test' tunes on the test rows,
    # which makes the reported test error optimistic
    selection: str = "validation"


@dataclass
class Outcome:
    studies: dict[str, Study] = field(default_factory=dict)
    metrics: dict[str, dict[str, float | None]] = field(default_factory=dict)
    run_ids: dict[str, str] = field(default_factory=dict)
    best: dict | None = None
    registration: registry.Registration | None = None


def prepare(df: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows with a target and wanted columns only (persisted; the caller releases them), the same with a row-wise
    `split` column, and the features present."""
    features = [c for c in s.features if c in df.columns and c not in s.exclude and c != s.target]
    rows = select_features(nan_to_null(with_target(df, s.target)), features, [*s.key, s.target])
    rows = spread(rows.withColumn(s.target, F.col(s.target).cast("double")), s.key)
    labelled = quantile_label(rows, s.target, 4, "__label")
    return rows, stratified_split(labelled, "__label", s.key, s.test, s.seed).drop("__label"), features


def tune(train: DataFrame, test: DataFrame, features: Sequence[str], s: Settings) -> dict[str, Study]:
    """One seeded study per profile; preparation is fitted on the rows the trials are fitted on."""
    spark = train.sparkSession
    unread, folds = [c for c in train.columns if c not in {*features, s.target}], []

    def narrow(rows: DataFrame) -> DataFrame:
        """Kept narrow, so that no row is hashed again by the search for the cuts or by what reads a side of them."""
        folds.append(rows.drop(*unread).persist(StorageLevel.MEMORY_AND_DISK))
        return folds[-1]

    if s.selection == "validation":
        folded = kfold(train, s.key, 5, f"validation-{s.seed}", "__v", narrow)
        fitting, held = folded.where(F.col("__v") != 0), folded.where(F.col("__v") == 0)
    elif s.selection == "test":
        fitting, held = train, test
    else:
        raise ValueError(f"selection must be 'validation' or 'test', not {s.selection!r}")
    prep = fit_prep(fitting, features)
    drawn = [Base(p, d) for p in s.profiles for d in draws_of(s.spaces[p], s.trials, s.seed)]
    weight = WEIGHT if all(b.plain for b in drawn) and repeated(fitting, prep.columns) else None
    fitting = condensed(fitting, prep, s.target) if weight else vectors(fitting, prep, [s.target])
    fitting = fitting.persist(StorageLevel.MEMORY_AND_DISK)
    held = vectors(held, prep, [s.target]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        def evaluate(profile: str):
            def run(params: dict[str, float]) -> float:
                model = Base(profile, params).estimator(s.target, weight=weight).fit(fitting)
                return rmse(model.transform(held).drop(VECTOR), s.target)
            return run

        return {p: search(spark, p, s.spaces[p], evaluate(p), s.trials, s.seed, s.parallelism) for p in s.profiles}
    finally:
        for kept in (fitting, held, *folds):
            kept.unpersist()


def _side_metrics(model: PipelineModel, rows: DataFrame, target: str) -> tuple[dict[str, float | None], dict[str, int]]:
    sides = regression_metrics(model.transform(rows), target).collect()
    values = {f"{r.split}_{m}": r[m] for r in sides for m in ("rmse", "mae", "r2")}
    return values, {f"n_{r.split}_samples": r.n for r in sides}


def _log(rows: DataFrame, train: DataFrame, features: Sequence[str], s: Settings, out: Outcome, name: str,
         model: PipelineModel, params: dict, extra: dict | None = None) -> None:
    metrics, sizes = _side_metrics(model, rows, s.target)
    metrics.update(extra or {})
    run = registry.Run(
        name, {**params, "n_features": len(features), **sizes}, metrics, {"source_table": s.source_table}, features)
    run_root = f"{s.root.rstrip('/')}/runs/{run.run_id}"
    run.model_path = registry.save_model(model, train, features, run_root)
    if any(hasattr(stage, "featureImportances") for stage in model.stages) and name != ENSEMBLE_RUN:
        importance(model, 20).coalesce(1).write.mode("overwrite").parquet(f"{run_root}/importance")
    registry.log_run(rows.sparkSession, f"{s.root.rstrip('/')}/log", run)
    out.metrics[name], out.run_ids[name] = metrics, run.run_id


def _log_study(study: Study, spark: SparkSession, s: Settings) -> None:
    """Append the trials and the tables their analysis consists of."""
    root = s.root.rstrip("/")
    trials = study.frame(spark)
    trials.coalesce(1).write.mode("append").parquet(f"{root}/trials")
    depth_points = trial_points(trials, "maxDepth")
    tables = {"history": trial_history(trials), "importance": param_importance(trials), "depth": depth_points,
              "summary": trial_summary(trials)}
    if "stepSize" in SPACES[study.name]:
        tables["step_size"] = trial_points(trials, "stepSize", "maxDepth")
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{root}/analysis/{study.name}/{name}")


def run_training(df: DataFrame, s: Settings) -> Outcome:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    out = Outcome()
    kept, rows, features = prepare(df, s)
    try:
        train, test = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "test")
        out.studies = tune(train, test, features, s)
        for study in out.studies.values():
            _log_study(study, spark, s)

        bases = {p: Base(p, study.best[2]) for p, study in out.studies.items()}
        for profile, base in bases.items():
            model = fit_single(train, features, s.target, base)
            _log(rows, train, features, s, out, profile, model, {
                **base.params, "model_type": profile, "optimization": "random_search", "n_trials": s.trials,
                "selection": s.selection,
            })

        def stacked(part: DataFrame) -> PipelineModel:
            return fit_stack(part, features, s.target, s.key, bases, s.folds, s.alpha, f"stack-{s.seed}", s.parallelism)

        scores = cross_validate(
            train, s.key, s.target, lambda fit, held: stacked(fit).transform(held), s.folds, s.seed, s.parallelism)
        summary = fold_summary(scores).first()
        _log(rows, train, features, s, out, ENSEMBLE_RUN, stacked(train), {
            "model_type": "stacking", "base_models": "+".join(bases), "meta_learner": "ridge", "cv_folds": s.folds,
        }, {"cv_rmse_mean": summary.rmse_mean, "cv_rmse_std": summary.rmse_std})
    finally:
        kept.unpersist()

    if s.catalog == "spark_catalog" or spark.conf.get(f"spark.sql.catalog.{s.catalog}", None):
        ensure_schema(spark, f"{s.catalog}.{MODEL_SCHEMA}")  # where the session has no such catalog, the registry's files are all there is
    best = registry.best_run(registry.read_runs(spark, f"{s.root.rstrip('/')}/log")).first()
    out.best = best.asDict()
    out.registration = registry.Registry(spark, s.root).promote(f"{s.catalog}.{MODEL_SCHEMA}.{s.model_name}", out.best, {
        "model_type": best["run_name"] or "Unknown",
        "test_rmse": str(best["metrics"].get("test_rmse")), "test_r2": str(best["metrics"].get("test_r2")),
        "use_case": MODEL_NAME, "training_date": date.today().isoformat(),
    })
    return out
