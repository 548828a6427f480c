"""The registered queries: every operator over the whole order tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.catalog import FEATURE_GROUPS, FEATURES
from regrove.functions.nulls import nan_to_null
from regrove.operators import explore, features, history, increments, prep, profile, sketches, split
from regrove.operators.metrics import cross_validate_ridge, fold_summary, linear_prediction, moments, no_moments, regression_metrics, ridge
from regrove.operators.selection import quantile_label
from regrove.plans import boosting, learners, modelling, registry, training, trials as trial_analysis
from regrove.session import scratch_path
from regrove.sources.feature_table import ROUTE, feature_table
from regrove.sources.tables import load
from regrove.sources.trips import TARGET, TRIP_KEY, trips

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 4, **special: int) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.select(*[
        F.round(f.name, special.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def _row_features(spark: SparkSession, sf_dir: str, target: str | None = None) -> DataFrame:
    """Trip frame with every row-wise feature, optionally of the rows that have `target`.

    Columns nobody asks for are pruned from the scan; the target filter is applied first,
    where the reader can use it.
    """
    frame = trips(spark, sf_dir)
    if target:
        frame = profile.with_target(frame, target)
    return features.row_features(nan_to_null(frame))


#: Numbers that identify a trip or its places, or are another target: no features.
NOT_FEATURES = [*TRIP_KEY, "DayNum", "VehId", "Trip", "start_timestamp_ms", "origin_nation", "dest_nation", "origin_lat", "origin_lon",
                "dest_lat", "dest_lon", TARGET, "planted_target"]
PREP_COLUMNS = ["distance_km", "avg_speed_kmh", "max_speed_kmh", "elevation_gain_m"]
RIDGE_COLUMNS = PREP_COLUMNS[:3]
PRESENCE = ["l_orderkey", "l_quantity", "distance_km", "l_shipdate", "avg_speed_kmh"]


def _ranked(spark: SparkSession, sf_dir: str, target: str = TARGET) -> DataFrame:
    frame = profile.with_target(feature_table(spark, sf_dir), target)
    return explore.target_correlation(frame, target, explore.numeric_features(frame, NOT_FEATURES))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which features move with the target, and which look like leaks."""
    top = explore.top_correlations(_ranked(spark, sf_dir), 15)
    leak = (F.abs("r") > explore.LEAK_THRESHOLD) & (F.col("feature") != TARGET)
    suspect = F.coalesce(leak, F.lit(False)).alias("suspect")
    return top.select("rank", "feature", F.round("r", 4).alias("r"), suspect)


def _split(spark: SparkSession, sf_dir: str, *columns: str, store: split.Store | None = None) -> DataFrame:
    base = trips(spark, sf_dir, [*TRIP_KEY, TARGET, *columns])
    return _stratified(profile.with_target(base, TARGET), TARGET, store)


def _stratified(base: DataFrame, target: str, store: split.Store | None = None) -> DataFrame:
    return split.stratified_split(quantile_label(base, target, 4, "label"), "label", TRIP_KEY, store=store)


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written: what reads them works out neither hash nor split again and holds no memory for them."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _side(rows: DataFrame, side: str) -> DataFrame:
    return rows.where(F.col("split") == side)


def _prep_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = prep.fit_prep(_side(_split(spark, sf_dir, *PREP_COLUMNS), "train"), PREP_COLUMNS)
    return rounded(fitted.frame(spark), 6)


def _prep_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir, *PREP_COLUMNS)
    fitted = prep.fit_prep(_side(rows, "train"), PREP_COLUMNS)
    return rounded(prep.apply_prep(rows, fitted, [*TRIP_KEY, "split"]))


def _line(train: DataFrame, other: DataFrame) -> DataFrame:
    """Least-squares line on distance: ridge without penalty."""
    fit = ridge(train, ["distance_km"], TARGET, alpha=0.0)
    return other.withColumn("prediction", linear_prediction(fit))


def _baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _split(spark, sf_dir, "distance_km")
    predicted = _line(_side(rows, "train"), rows)
    return rounded(regression_metrics(predicted, TARGET), r2=6)


def _cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _written(_side(_split(spark, sf_dir, "distance_km"), "train").drop("label", "split"), "train")
    # hashed once for the fits and the scores
    folded = split.kfold(train, TRIP_KEY, 5).select("fold", "distance_km", TARGET).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        folds = cross_validate_ridge(folded, ["distance_km"], TARGET, alpha=0.0)
        return spark.createDataFrame(folds.collect(), folds.schema)
    finally:
        folded.unpersist()


def _ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _side(_split(spark, sf_dir, *RIDGE_COLUMNS), "train")
    return rounded(ridge(train, RIDGE_COLUMNS, TARGET, alpha=1.0).frame(spark))


def _trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trial per supplier, one study per supplier nation."""
    error = F.col("l_extendedprice") - 50000
    measured = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(
        F.sqrt(F.avg(error * error)).alias("value"), F.avg(F.col("l_linenumber").cast("double")).alias("depth"),
        F.avg("l_discount").alias("learning_rate"), F.avg("l_tax").alias("random_strength"),
    )
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    params = [part for p in ("depth", "learning_rate", "random_strength") for part in (F.lit(p), F.col(p))]
    return measured.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")).alias("study"),
        F.col("l_suppkey").alias("number"), "value", F.create_map(*params).alias("params"),
    )


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per customer, shaped like the run log; some names and metrics are missing."""
    key, error = F.col("o_custkey"), F.col("o_totalprice") - 100000
    grouped = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(
        F.sqrt(F.avg(error * error)).alias("e"), (F.avg("o_totalprice") / 1000000).alias("r2"),
    )
    return grouped.select(
        key.cast("string").alias("run_id"),
        F.when(key % 7 != 0, F.concat(F.lit("run-"), (key % 20).cast("string"))).alias("run_name"),
        F.create_map(
            F.lit("test_rmse"), F.when(key % 11 != 0, F.col("e")), F.lit("test_r2"), F.when(key % 13 != 0, F.col("r2")),
        ).alias("metrics"),
    )


def _run_columns(runs: DataFrame) -> DataFrame:
    return rounded(runs.select(
        *[c for c in ("rank",) if c in runs.columns],
        "run_id", "run_name", F.col("metrics")["test_rmse"].alias("test_rmse"), F.col("metrics")["test_r2"].alias("test_r2"),
    ), test_r2=6)


def _scaled(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Energy on a scale whose means are not short decimals, so engines cannot round a tie apart."""
    frame = trips(spark, sf_dir, [*TRIP_KEY, "feature_timestamp", *columns])
    return frame.withColumn("energy", F.col("price_cents") / F.lit(9973.0))


def _vehicle_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _scaled(spark, sf_dir, "VehId", "distance_km")
    out = history.vehicle_history(frame, energy="energy")
    return rounded(out.drop("feature_timestamp", "VehId", "distance_km", "energy"))


def _fleet_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _scaled(spark, sf_dir, "VehId", "distance_km")
    frame = history.vehicle_history(scaled, energy="energy")
    return rounded(history.fleet_ratio(frame, history.fleet_efficiency(scaled, "energy")).select(*TRIP_KEY, "vehicle_efficiency_vs_fleet"), 6)


def _route_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _route_frame(spark, sf_dir)
    return _route_columns(history.route_history(frame, ROUTE, TRIP_KEY, energy="energy", duration="duration", speed="speed"))


#: Where the trips are cut into batches that follow each other in time.
BATCH_DAYS = ["1997-04-01", "1999-07-01"]


def _in_batches(frame: DataFrame, merge: Callable[[DataFrame, str, int], DataFrame]) -> DataFrame:
    """The rows of a frame, stretch of time by stretch of time, with what `merge(batch, root, number)` adds to each."""
    root, day = scratch_path(frame.sparkSession, "increments"), F.to_date("feature_timestamp")
    bounds = [None, *BATCH_DAYS, None]
    out = None
    for number, (low, high) in enumerate(zip(bounds, bounds[1:])):
        batch = frame
        if low:
            batch = batch.where(day >= F.lit(low).cast("date"))
        if high:
            batch = batch.where(day < F.lit(high).cast("date"))
        done = merge(batch, root, number)
        out = done if out is None else out.unionByName(done)
    return out


def _vehicle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = _scaled(spark, sf_dir, "VehId", "distance_km")
    out = _in_batches(frame, lambda batch, root, number: increments.vehicle_batch(batch, root, number, energy="energy"))
    return rounded(out.drop("feature_timestamp", "VehId", "distance_km", "energy"))


def _route_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir, *ROUTE, "duration_minutes", "avg_speed_kmh").withColumns({
        "duration": F.col("duration_minutes") / F.lit(9.973), "speed": F.round("avg_speed_kmh"),
    })


def _route_columns(out: DataFrame) -> DataFrame:
    return rounded(out.select(
        *TRIP_KEY, "route_avg_energy_last10", "route_avg_duration_last10", "route_avg_speed_last10", "route_trip_count",
    ))


def _route_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _route_columns(_in_batches(_route_frame(spark, sf_dir), lambda batch, root, number: increments.route_batch(
        batch, root, number, ROUTE, TRIP_KEY, energy="energy", duration="duration", speed="speed")))


def _sketch_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per year, written and merged; the estimates are held against the rows themselves."""
    columns = [TARGET, "distance_km", "avg_speed_kmh", "elevation_gain_m", "price_cents"]
    frame = trips(spark, sf_dir, [*columns, "feature_timestamp"]).withColumn("year", F.year("feature_timestamp"))
    path = scratch_path(spark, "sketches")
    sketches.sketch_parts(frame, columns, "year").write.parquet(path)
    found = sketches.sketch_profile(sketches.merge_parts(spark.read.parquet(path)))
    errors = sketches.rank_errors(frame, found)
    exact = frame.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    rows = [(r["column"], r["n_total"], r["n_present"], r["low"], r["high"], errors[r["column"]] <= 0.01,
             abs(r["n_distinct"] - exact[r["column"]]) <= 0.05 * exact[r["column"]]) for r in found.collect()]
    return rounded(spark.createDataFrame(rows, "column string, n_total long, n_present long, low double, high double, quantiles_within boolean, distinct_within boolean"))


def _time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    return rounded(features.time_patterns(features.time_parts(events, "ts")).drop("ts"), 6)


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.feature_catalog(feature_table(spark, sf_dir), FEATURE_GROUPS)


def _distinct_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = features.time_parts(trips(spark, sf_dir, ["feature_timestamp"]))
    return profile.distinct_sample(frame, ["trip_year", "trip_month", "trip_dayofweek", "trip_hour"])


def _scatter(x: str) -> Query:
    # energy in integer cents, so cell means are exact in either engine
    return lambda spark, sf_dir: rounded(
        explore.scatter_bins(trips(spark, sf_dir, [x, "price_cents"]), x, "price_cents", 50))


def _features(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _row_features(spark, sf_dir).select(*TRIP_KEY, *columns)


# --- fitted trees: compared by rows only, few and small trees -----------------------------------

MODEL_FEATURES = ["distance_km", "avg_speed_kmh", "max_speed_kmh", "elevation_gain_m", "DayNum"]
PLANTED = "planted_target"
BASES = {
    "boost_deep": modelling.Base("boost_deep", {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.8}),
    "forest": modelling.Base("forest", {"numTrees": 5, "maxDepth": 5, "subsamplingRate": 0.8, "featureSubset": 0.9}),
    "boost_shallow": modelling.Base("boost_shallow", {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3, "maxBins": 64}),
}


def _planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the planted problem, kept with their split: every fit reads them several times. Samples of the learners follow this dealing."""
    base = profile.with_target(trips(spark, sf_dir, [*TRIP_KEY, PLANTED, *MODEL_FEATURES]), PLANTED)
    rows = _stratified(nan_to_null(base), PLANTED).drop("label")
    return modelling.spread(rows, TRIP_KEY)


def _predict(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _planted(spark, sf_dir)
        model = modelling.fit_single(_side(rows, "train"), MODEL_FEATURES, PLANTED, BASES[name])
        return model.transform(rows).select(*TRIP_KEY, "split", PLANTED, "prediction")
    return run


def _importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _side(_planted(spark, sf_dir), "train")
    return modelling.importance(modelling.fit_single(train, MODEL_FEATURES, PLANTED, BASES["forest"]), 20)


def _stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted(spark, sf_dir)
    model = modelling.fit_stack(_side(rows, "train"), MODEL_FEATURES, PLANTED, TRIP_KEY, BASES, k=5, parallelism=2)
    return model.transform(rows).select(*TRIP_KEY, "split", PLANTED, "prediction")


def _score_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit two learners, log both runs, register the better one and score every row with the champion."""
    rows, root = _planted(spark, sf_dir), scratch_path(spark, "registry")
    train = _side(rows, "train")
    for name, model in modelling.fit_each(train, MODEL_FEATURES, PLANTED, {n: BASES[n] for n in ("boost_shallow", "forest")}).items():
        error = modelling.rmse(model.transform(_side(rows, "test")), PLANTED)
        run = registry.Run(name, BASES[name].params, {"test_rmse": error}, {}, MODEL_FEATURES)
        run.model_path = registry.save_model(model, train, MODEL_FEATURES, f"{root}/runs/{run.run_id}")
        registry.log_run(spark, f"{root}/log", run)
    best = registry.best_run(registry.read_runs(spark, f"{root}/log")).first()
    models = registry.Registry(spark, root)
    outcome = models.promote("trip-energy", best.asDict(), {"model_type": best["run_name"]})
    if outcome.error:
        raise RuntimeError(outcome.error)
    return models.score("trip-energy", rows).select(*TRIP_KEY, "split", PLANTED, "prediction")


# --- trees whose predictions are plain means, so that SQL can check them ----------------------------

STEPPED, STEPS = "stepped", ["distance_km", "l_linenumber"]
#: One tree over all rows and all features.
ONE_TREE = {"numTrees": 1, "maxBins": 64, "bootstrap": False, "subsamplingRate": 1.0, "featureSubset": 1.0}
STUMP_AND_TREE = {
    "stump": modelling.Base("boost_shallow", {"maxIter": 1, "maxDepth": 1, "maxBins": 64}),
    "tree": modelling.Base("forest", ONE_TREE | {"maxDepth": 2}),
}


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole cents with a high step in one feature and a lower one in another: sums are exact, and no other split is better."""
    rows = _split(spark, sf_dir, *STEPS[:1], store=lambda rows: _written(rows.drop(TARGET, "label"), "stepped"))
    high, low = F.col("distance_km") >= 25, F.col("l_linenumber") >= 4
    stepped = F.col("price_cents") + F.when(high, 1_000_000_000).otherwise(0) + F.when(low, 100_000_000).otherwise(0)
    return rows.select(*TRIP_KEY, *STEPS[:1], stepped.alias(STEPPED), "split")


def _millions(rows: DataFrame) -> DataFrame:
    return rounded(rows.select(*TRIP_KEY, "split", (F.col("prediction") / 1_000_000).alias("prediction")))


def _one_tree(name: str, params: dict) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _stepped(spark, sf_dir)
        return _millions(modelling.fit_single(_side(rows, "train"), STEPS, STEPPED, modelling.Base(name, params)).transform(rows))
    return run


def _importance_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = _side(_stepped(spark, sf_dir), "train")
    model = modelling.fit_single(train, STEPS, STEPPED, modelling.Base("forest", ONE_TREE | {"maxDepth": 1}))
    return rounded(modelling.importance(model))


def _stack_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stepped(spark, sf_dir)
    return _millions(modelling.fit_stack(_side(rows, "train"), STEPS, STEPPED, TRIP_KEY, STUMP_AND_TREE, k=5, parallelism=5).transform(rows))


def _champion_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both trees are logged, the better one is registered under a schema of its own, and the alias holder scores every row."""
    rows, root = _stepped(spark, sf_dir), scratch_path(spark, "registry")
    train = _side(rows, "train")
    for name, model in modelling.fit_each(train, STEPS, STEPPED, STUMP_AND_TREE).items():
        run = registry.Run(name, dict(STUMP_AND_TREE[name].params), {"test_rmse": modelling.rmse(model.transform(_side(rows, "test")), STEPPED)}, {}, STEPS)
        run.model_path = registry.save_model(model, train, STEPS, f"{root}/runs/{run.run_id}")
        registry.log_run(spark, f"{root}/log", run)
    models = registry.Registry(spark, root)
    outcome = models.promote("dev.ml_models.stepped", registry.best_run(registry.read_runs(spark, f"{root}/log")).first().asDict())
    if outcome.error:
        raise RuntimeError(outcome.error)
    return _millions(models.score("dev.ml_models.stepped", rows))


#: Small boosted models over the stepped target: every split and leaf value of theirs is a few lines of SQL.
BOOSTED = {
    "boost_regularised": boosting.settings("boost_regularised", {
        "n_estimators": 2, "max_depth": 1, "learning_rate": 0.5, "min_child_weight": 7, "gamma": 0.5, "reg_alpha": 1e10, "reg_lambda": 100.0}),
    "boost_leaves": boosting.settings("boost_leaves", {"n_estimators": 1, "num_leaves": 3, "learning_rate": 0.3, "min_child_samples": 20, "reg_lambda": 1.0}),
    "boost_symmetric": boosting.settings("boost_symmetric", {"iterations": 1, "depth": 2, "learning_rate": 0.3, "l2_leaf_reg": 3.0, "border_count": 254}),
    "boost_bagged": boosting.Boosting(trees=1, max_depth=1, learning_rate=0.5, bagging_temperature=1.0),
    "boost_columns": boosting.Boosting(trees=2, max_depth=1, learning_rate=0.5, column_share=0.5, seed=1),
}


def _boosted(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _stepped(spark, sf_dir)
        return _millions(boosting.fit_boosting(_side(rows, "train"), STEPS, STEPPED, TRIP_KEY, BOOSTED[name]).transform(rows))
    return run


def _search_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 seeded draws of a ridge penalty, each judged on a held-out fold of the training rows."""
    train = _side(_split(spark, sf_dir, "distance_km"), "train")
    folded = split.kfold(train, TRIP_KEY, 5, "validation-42", "v").select("v", "distance_km", TARGET).persist()
    fitting, held = folded.where("v <> 0"), folded.where("v = 0")

    fitted = moments(fitting, ["distance_km", TARGET]).get(0, no_moments(2))

    def evaluate(draws: list[dict[str, float]]) -> list[float]:
        """One scan for all fits, one for all scores."""
        fits = [fitted.ridge(["distance_km"], d["alpha"]) for d in draws]
        errors = [F.col(TARGET) - linear_prediction(fit) for fit in fits]
        return list(held.agg(*[F.sqrt(F.avg(e * e)).alias(f"e{i}") for i, e in enumerate(errors)]).first())

    try:
        study = learners.search_together(spark, "alpha", {"alpha": learners.LogFloat(1.0, 10_000_000.0)}, evaluate, 25, 42)
    finally:
        folded.unpersist()
    history = trial_analysis.trial_history(study.frame(spark))
    return rounded(history.select("number", "value", "best_value", "is_best"))


def _search_halving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws, pruned: a ninth and a third of the rows judge the first rungs, all rows the last."""
    train = _side(_split(spark, sf_dir, "distance_km"), "train")
    folded = split.kfold(train, TRIP_KEY, 5, "validation-42", "v").select("v", "distance_km", TARGET, split.row_hash(TRIP_KEY, "halving-42").alias("hash")).persist()

    def evaluate(draws: list[dict[str, float]], share: float) -> list[float]:
        rows = folded.where(F.substring("hash", 1, 6) < f"{int(share * 16 ** 6):06x}") if share < 1 else folded
        fitted = moments(rows.where("v <> 0"), ["distance_km", TARGET]).get(0, no_moments(2))
        errors = [F.col(TARGET) - linear_prediction(fitted.ridge(["distance_km"], d["alpha"])) for d in draws]
        return list(rows.where("v = 0").agg(*[F.sqrt(F.avg(e * e)).alias(f"e{i}") for i, e in enumerate(errors)]).first())

    try:
        found = learners.halving("alpha", {"alpha": learners.LogFloat(1.0, 10_000_000.0)}, evaluate, 25, 42)
    finally:
        folded.unpersist()
    best = found.best[0]
    rows = [(number, rung, value, number == best) for number, rung, value in found.rows()]
    return rounded(spark.createDataFrame(rows, "number int, rung int, value double, is_best boolean"))


def _tune_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree objective over depths 1 and 2 of one tree, judged on a held-out fold of the training rows."""
    rows = _stepped(spark, sf_dir)
    settings = training.Settings(
        root="", key=TRIP_KEY, target=STEPPED, trials=4, parallelism=2, profiles=("forest",),
        spaces={"forest": {"maxDepth": learners.Int(1, 2), **{k: learners.Fixed(v) for k, v in ONE_TREE.items()}}})
    study = training.tune(_side(rows, "train"), _side(rows, "test"), STEPS, settings)["forest"]
    trials = [(number, int(params["maxDepth"]), value / 1_000_000) for number, value, params in study.trials]
    return rounded(spark.createDataFrame(trials, "number int, depth int, value double"))


def _target_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = trips(spark, sf_dir).withColumn("nothing", F.lit(None).cast("double"))
    rows = [(c, explore.target_status(frame, c)) for c in (TARGET, "elevation_gain_m", "nothing", "no_such_column")]
    return spark.createDataFrame(rows, "target string, status string")


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations among the twelve columns that the ranking puts first."""
    frame = feature_table(spark, sf_dir)
    ranked = explore.target_correlation(profile.with_target(frame, TARGET), TARGET, explore.numeric_features(frame, NOT_FEATURES))
    top = [r["feature"] for r in explore.top_correlations(ranked, 12).collect()]
    return rounded(explore.correlation_matrix(frame, top))


def queries() -> dict[str, Query]:
    profiled = [TARGET, "distance_km", "duration_minutes", "avg_speed_kmh", "max_speed_kmh", "avg_battery_soc",
                "avg_elevation_m", "elevation_gain_m"]
    return {
        "flagship": flagship,
        "table_scan": lambda s, d: load(s, f"{d}/lineitem.parquet"),
        "shape": lambda s, d: profile.shape(load(s, f"{d}/lineitem.parquet")),
        "missing_profile": lambda s, d: profile.missing_profile(trips(s, d, profiled)),
        "selected_missing": lambda s, d: profile.missing_profile(profile.select_features(feature_table(s, d), FEATURES)),
        "target_summary": lambda s, d: rounded(profile.describe_target(trips(s, d, [TARGET]), TARGET)),
        "feature_catalog": _catalog,
        "column_range": lambda s, d: profile.column_range(trips(s, d, ["trip_date"]), "trip_date"),
        "distinct_sample": _distinct_sample,
        "histogram": lambda s, d: rounded(explore.histogram(trips(s, d, [TARGET]), TARGET, 50)),
        "scatter_bins": _scatter("distance_km"),
        "scatter_speed": _scatter("avg_speed_kmh"),
        "scatter_elevation": _scatter("elevation_gain_m"),
        "scatter_sample": lambda s, d: explore.scatter_points(
            trips(s, d, [*TRIP_KEY, "avg_speed_kmh", TARGET]), "avg_speed_kmh", TARGET, 0.1, TRIP_KEY),
        "scatter_points": lambda s, d: explore.scatter_points(trips(s, d, ["avg_speed_kmh", TARGET]), "avg_speed_kmh", TARGET),
        "target_correlation": lambda s, d: rounded(_ranked(s, d)),
        "correlation_top15": lambda s, d: rounded(explore.top_correlations(_ranked(s, d), 15)),
        "correlation_matrix": _matrix,
        "leakage_check": lambda s, d: rounded(explore.leakage_check(_ranked(s, d, PLANTED), PLANTED)),
        "with_target": lambda s, d: profile.with_target(
            trips(s, d, [*TRIP_KEY, "distance_km", "avg_speed_kmh"]), "avg_speed_kmh"),
        "select_features": lambda s, d: profile.select_features(trips(s, d), FEATURES, TRIP_KEY),
        "quantile_label": lambda s, d: quantile_label(trips(s, d, [*TRIP_KEY, TARGET]), TARGET).drop(TARGET),
        "quantile_label_ties": lambda s, d: quantile_label(trips(s, d, [*TRIP_KEY, "elevation_gain_m"]), "elevation_gain_m"),
        "stratified_split": lambda s, d: _split(s, d).drop(TARGET),
        "split_summary": lambda s, d: rounded(split.split_summary(_split(s, d), TARGET)),
        "prep_params": _prep_params,
        "prep_apply": _prep_apply,
        "baseline_metrics": _baseline_metrics,
        "kfold": lambda s, d: split.kfold(trips(s, d, TRIP_KEY), TRIP_KEY),
        "cross_validation": lambda s, d: rounded(_cross_validation(s, d)),
        "cv_summary": lambda s, d: rounded(fold_summary(_cross_validation(s, d))),
        "ridge": _ridge,
        "search_runs": lambda s, d: _run_columns(registry.search_runs(_runs(s, d))),
        "compare_runs": lambda s, d: rounded(registry.compare_runs(_runs(s, d)), test_r2=6),
        "best_run": lambda s, d: _run_columns(registry.best_run(_runs(s, d))).withColumn(
            "run_name", F.coalesce("run_name", F.lit("Unknown"))),
        "trial_history": lambda s, d: rounded(trial_analysis.trial_history(_trials(s, d))),
        "param_importance": lambda s, d: rounded(trial_analysis.param_importance(_trials(s, d))),
        "trial_points": lambda s, d: rounded(
            trial_analysis.trial_points(_trials(s, d), "learning_rate", "random_strength"), x=6, colour=6),
        "trial_summary": lambda s, d: rounded(trial_analysis.trial_summary(_trials(s, d))),
        "vehicle_history": _vehicle_history,
        "route_history": _route_history,
        "fleet_ratio": _fleet_ratio,
        "time_features": _time_features,
        "rounded_coordinates": lambda s, d: _features(
            s, d, "origin_lat_rounded", "origin_lon_rounded", "dest_lat_rounded", "dest_lon_rounded"),
        "interaction_features": lambda s, d: _features(
            s, d, "distance_elevation_interaction", "speed_squared", "speed_per_distance", "duration_per_distance",
            "speed_variability"),
        "ratio_features": lambda s, d: _features(
            s, d, "elevation_gradient", "actual_speed_efficiency", "speed_efficiency_ratio", "elevation_per_minute",
            "trip_complexity_score"),
        "battery_features": lambda s, d: _features(s, d, "battery_soc_range", "battery_usage_rate", "energy_per_km"),
        "category_codes": lambda s, d: _features(s, d, "distance_category", "speed_category"),
        "gbt_predict": _predict("boost_deep"),
        "forest_predict": _predict("forest"),
        "shallow_predict": _predict("boost_shallow"),
        "importance": _importance,
        "stacking": _stacking,
        "score_champion": _score_champion,
        "tree_exact": _one_tree("boost_shallow", {"maxIter": 1, "maxDepth": 1, "maxBins": 64}),
        "forest_exact": _one_tree("forest", ONE_TREE | {"maxDepth": 2}),
        "importance_exact": _importance_exact,
        "stack_exact": _stack_exact,
        "champion_exact": _champion_exact,
        "search_alpha": _search_alpha,
        "search_halving": _search_halving,
        "tune_exact": _tune_exact,
        "scatter_bottom_k": lambda s, d: explore.scatter_points(
            trips(s, d, [*TRIP_KEY, "avg_speed_kmh", TARGET]), "avg_speed_kmh", TARGET, key=TRIP_KEY, max_points=500),
        "sketch_profile": _sketch_profile,
        "vehicle_batches": _vehicle_batches,
        "route_batches": _route_batches,
        "dtype_counts": lambda s, d: profile.dtype_counts(load(s, f"{d}/lineitem.parquet")),
        "feature_presence": lambda s, d: profile.feature_presence(load(s, f"{d}/lineitem.parquet"), PRESENCE),
        "target_guards": _target_guards,
        **{name: _boosted(name) for name in BOOSTED},
    }
