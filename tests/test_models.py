import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from regrove.operators.metrics import regression_metrics
from regrove.operators.split import kfold
from regrove.plans import learners, modelling, registry, training
from regrove.plans.learners import Float, Int, LogFloat
from regrove.sources.trips import TRIP_KEY, trips

FEATURES = ["distance_km", "avg_speed_kmh", "max_speed_kmh"]
TARGET = "planted_target"
BASES = {
    "boost_deep": modelling.Base("boost_deep", {"maxIter": 15, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.9, "featureSubset": 1.0}),
    "forest": modelling.Base("forest", {"numTrees": 15, "maxDepth": 7, "featureSubset": 0.9}),
    "boost_shallow": modelling.Base("boost_shallow", {"maxIter": 15, "maxDepth": 4, "stepSize": 0.3, "maxBins": 64}),
}


@pytest.fixture(scope="module")
def rows(spark, sf):
    frame = trips(spark, sf, [*TRIP_KEY, TARGET, *FEATURES])
    folded = kfold(frame, TRIP_KEY, 2).withColumn("split", F.when(F.col("fold") == 0, "train").otherwise("test"))
    return folded.drop("fold").persist()


@pytest.fixture(scope="module")
def train(rows):
    return rows.where("split = 'train'")


@pytest.mark.parametrize("name", list(BASES))
def test_each_learner_finds_the_planted_target(rows, train, name):
    model = modelling.fit_single(train, FEATURES, TARGET, BASES[name])
    scored = model.transform(rows)
    assert scored.columns == [*rows.columns, "prediction"]
    for r in regression_metrics(scored, TARGET).collect():
        assert r.r2 > 0.9
    ranked = modelling.importance(model).collect()
    assert ranked[0].feature == "distance_km" and len(ranked) == 3
    assert math.isclose(sum(r.importance for r in ranked), 1.0, rel_tol=1e-6)


def test_stack_is_as_good_as_its_best_base_and_reloads(spark, rows, train, tmp_path):
    test = rows.where("split = 'test'")
    single = [modelling.rmse(modelling.fit_single(train, FEATURES, TARGET, b).transform(test), TARGET) for b in BASES.values()]
    model = modelling.fit_stack(train, FEATURES, TARGET, TRIP_KEY, BASES, k=3, parallelism=2)
    scored = model.transform(test)
    assert modelling.rmse(scored, TARGET) <= 1.05 * min(single)
    assert scored.columns == [*rows.columns, "prediction"]
    path = registry.save_model(model, train, FEATURES, str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(path).transform(test)
    joined = scored.select(*TRIP_KEY, "prediction").join(again.select(*TRIP_KEY, F.col("prediction").alias("p2")), TRIP_KEY)
    assert joined.where("prediction != p2").count() == 0 and joined.count() == test.count()
    assert spark.read.parquet(str(tmp_path / "m/example")).count() == 3
    assert spark.read.parquet(str(tmp_path / "m/signature")).first().features == FEATURES


def test_out_of_fold_covers_every_row_once(spark, train):
    prep = modelling.fit_prep(train, FEATURES)
    folded = modelling.vectors(kfold(train, TRIP_KEY, 3, 1, modelling.FOLD), prep, [*TRIP_KEY, TARGET, modelling.FOLD])
    small = {"forest": modelling.Base("forest", {"numTrees": 2, "maxDepth": 3})}
    out = modelling.out_of_fold(folded, TARGET, small, 3)
    assert out.count() == out.select(*TRIP_KEY).distinct().count() == train.count()


def test_cross_validation_refits_per_fold(spark, train):
    seen = []

    def fit_predict(fit, held):
        seen.append((fit.count(), held.count()))
        mean = fit.agg(F.avg(TARGET)).first()[0]
        return held.withColumn("prediction", F.lit(mean))

    scores = modelling.cross_validate(train, TRIP_KEY, TARGET, fit_predict, 4)
    n = train.count()
    assert [r.fold for r in scores.orderBy("fold").collect()] == [0, 1, 2, 3]
    assert all(a + b == n for a, b in seen) and sum(b for _, b in seen) == n


def test_search_is_seeded_and_parallelism_does_not_matter(spark):
    space = {"a": Int(1, 9), "b": Float(0.5, 1.0), "c": LogFloat(0.01, 0.3)}

    def value(p):
        return (p["a"] - 4) ** 2 + p["b"] + p["c"]

    one = learners.search(spark, "s", space, value, 25, 42, 1)
    many = learners.search(spark, "s", space, value, 25, 42, 4)
    assert one == many and one != learners.search(spark, "s", space, value, 25, 43, 1)
    assert one.best[1] == min(t[1] for t in one.trials)
    for _, _, p in one.trials:
        assert 1 <= p["a"] <= 9 and 0.5 <= p["b"] <= 1.0 and 0.01 <= p["c"] <= 0.3
    assert one.frame(spark).count() == 25


@pytest.mark.parametrize("profile", learners.PROFILES)
def test_every_drawn_setting_is_accepted(spark, profile):
    import random
    rng = random.Random(0)
    for _ in range(20):
        params = {k: d.draw(rng) for k, d in learners.SPACES[profile].items()}
        estimator = learners.learner(profile, params, "y")
        trees = estimator.getNumTrees() if profile == "forest" else estimator.getMaxIter()
        assert trees == params["numTrees" if profile == "forest" else "maxIter"]
    with pytest.raises(ValueError):
        learners.learner("nope", {}, "y")


@pytest.mark.parametrize("selection", ["validation", "test"])
def test_whole_training_job(spark, sf, tmp_path, selection):
    frame = trips(spark, sf, [*TRIP_KEY, TARGET, *FEATURES])
    settings = training.Settings(
        root=str(tmp_path), key=TRIP_KEY, target=TARGET, features=[*FEATURES, "not_there"], trials=2, folds=2,
        spaces={p: {k: d for k, d in learners.SPACES[p].items()} | {"numTrees" if p == "forest" else "maxIter": learners.Int(2, 3)} for p in ("forest", "boost_shallow")},
        selection=selection, profiles=["forest", "boost_shallow"], parallelism=2)
    outcome = training.run_training(frame, settings)
    assert outcome.registration.version == 1 and outcome.registration.error is None
    runs = registry.read_runs(spark, f"{tmp_path}/log")
    assert {r.run_name for r in runs.collect()} == {"forest", "boost_shallow", training.ENSEMBLE_RUN}
    assert outcome.best["metrics"]["test_rmse"] == min(m["test_rmse"] for m in outcome.metrics.values())
    assert "cv_rmse_std" in outcome.metrics[training.ENSEMBLE_RUN]
    trials = spark.read.parquet(f"{tmp_path}/trials").collect()
    assert len(trials) == 4
    logged = {r.run_name: r.params for r in runs.collect()}
    for name, trees in (("forest", "numTrees"), ("boost_shallow", "maxIter")):
        model = PipelineModel.load(next(r.model_path for r in runs.collect() if r.run_name == name))
        fitted = next(s for s in model.stages if hasattr(s, "featureImportances"))
        assert fitted.getNumTrees == float(logged[name][trees])
    scored = registry.Registry(spark, str(tmp_path)).score(f"dev.ml_models.{settings.model_name}", frame)
    assert scored.where("prediction is null").count() == 0 and scored.count() == 6000


def test_nodes_are_kept_for_large_trees_alone():
    from regrove.plans.learners import learner

    def kept(profile, **params):
        return learner(profile, params, "y").getCacheNodeIds()

    assert not kept("boost_deep", maxIter=500, maxDepth=4) and not kept("forest", numTrees=5, maxDepth=5)
    assert kept("forest", numTrees=1000, maxDepth=6) and kept("boost_deep", maxIter=5, maxDepth=12)


FEW = {"stump": modelling.Base("boost_shallow", {"maxIter": 3, "maxDepth": 2, "maxBins": 64}),
       "tree": modelling.Base("forest", {"numTrees": 1, "bootstrap": False, "subsamplingRate": 1.0, "featureSubset": 1.0, "maxDepth": 2})}


@pytest.fixture()
def few_vectors(spark):
    """2,000 rows of 21 vectors, some with a missing input; targets vary within a vector."""
    return spark.range(2000).select("id", F.when(F.col("id") % 7 > 0, (F.col("id") % 7).cast("double")).alias("a"), (F.col("id") % 3).cast("int").alias("b"),
                                    (F.col("id") % 7 * 10 + F.col("id") % 3 * 100 + F.col("id") % 11).alias("y"))


def test_fits_on_condensed_rows_equal_fits_on_all_rows(few_vectors, monkeypatch):
    seen, made = [], modelling.Base.estimator

    def spy(base, label, prediction="prediction", weight=None):
        seen.append(weight)
        return made(base, label, prediction, weight)

    def predictions():
        models = [modelling.fit_single(few_vectors, ["a", "b"], "y", b) for b in FEW.values()]
        models.append(modelling.fit_stack(few_vectors, ["a", "b"], "y", ["id"], FEW, 3, parallelism=2))
        return [[r["prediction"] for r in m.transform(few_vectors).orderBy("id").collect()] for m in models]

    monkeypatch.setattr(modelling.Base, "estimator", spy)
    condensed = predictions()
    assert seen == [modelling.WEIGHT] * 10
    monkeypatch.setattr(modelling, "REPEATS", 10 ** 9)
    for few, every in zip(condensed, predictions()):
        assert few == pytest.approx(every, rel=1e-9)
    assert seen[10:] == [None] * 10


def test_condensed_rows_keep_number_and_mean_and_missing_targets(few_vectors):
    prep = modelling.fit_prep(few_vectors, ["a", "b"])
    rows = modelling.condensed(few_vectors, prep, "y").collect()
    assert len(rows) == 21 and sum(r[modelling.WEIGHT] for r in rows) == 2000
    total = few_vectors.agg(F.sum("y")).first()[0]
    assert sum(r[modelling.WEIGHT] * r["y"] for r in rows) == pytest.approx(total)
    holed = few_vectors.withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    for base in FEW.values():
        with pytest.raises(Exception, match="(?i)null"):
            modelling.fit_single(holed, ["a", "b"], "y", base)


def test_only_fits_that_count_every_row_once_are_plain():
    assert all(b.plain for b in FEW.values())
    for params in ({"subsamplingRate": 0.8}, {"minInstancesPerNode": 5}):
        assert not any(modelling.Base(b.profile, b.params | params).plain for b in FEW.values())
    assert not modelling.Base("forest", {"numTrees": 5}).plain


def test_weighted_moments_are_those_of_the_rows(spark):
    from regrove.operators.metrics import moments, weighted_moments

    df = spark.createDataFrame([(1.0, 2.0, 3.0), (4.0, 1.0, 2.0), (2.5, 7.0, 1.0), (None, 5.0, 4.0)], "x double, y double, w double")
    got = weighted_moments(df, ["x", "y"], "w")
    every = moments(df.select("x", "y", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))), ["x", "y"])[0]
    assert got.n == every.n == 6 and got.means == pytest.approx(every.means)
    assert got.products.ravel() == pytest.approx(every.products.ravel())
    assert weighted_moments(df.where("w > 9"), ["x", "y"], "w").n == 0


def test_tuning_fits_distinct_vectors_and_judges_all_held_rows(few_vectors, monkeypatch):
    settings = training.Settings(root="", key=["id"], target="y", trials=2, parallelism=2, profiles=("forest",), spaces={
        "forest": {k: learners.Fixed(v) for k, v in FEW["tree"].params.items()}})
    made, asked = modelling.condensed, []
    monkeypatch.setattr(training, "condensed", lambda *a: asked.append(1) or made(*a), raising=False)
    few = training.tune(few_vectors, few_vectors, ["a", "b"], settings)["forest"].trials
    assert asked == [1]
    monkeypatch.setattr(modelling, "REPEATS", 10 ** 9)
    every = training.tune(few_vectors, few_vectors, ["a", "b"], settings)["forest"].trials
    assert [t[1] for t in few] == pytest.approx([t[1] for t in every], rel=1e-9)


def test_learners_fitted_together_equal_those_fitted_alone(few_vectors, monkeypatch):
    """One preparation for all; those that see distinct vectors and those that sample rows each get their own kind of rows."""
    bases = FEW | {"bagged": modelling.Base("forest", {"numTrees": 2, "maxDepth": 2})}
    alone = {n: modelling.fit_single(few_vectors, ["a", "b"], "y", b) for n, b in bases.items()}
    made, asked = modelling.fit_prep, []
    monkeypatch.setattr(modelling, "fit_prep", lambda *a: asked.append(1) or made(*a))
    together = modelling.fit_each(few_vectors, ["a", "b"], "y", bases)
    assert asked == [1] and list(together) == list(bases)
    for n, model in together.items():
        got, expected = ([r["prediction"] for r in m.transform(few_vectors).orderBy("id").collect()] for m in (model, alone[n]))
        assert got == pytest.approx(expected, rel=1e-9)


def counted(df):
    """The frame, and the rows of it that tasks have read so far."""
    reads = df.sparkSession.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return df.mapInArrow(read, df.schema), reads


def test_champion_reads_the_trips_four_times(spark, monkeypatch):
    """Twice for the quantiles, once for the sizes of the classes, once to hash and write them: not once more for the cuts."""
    from regrove.plans import registered

    trip = spark.range(3000).select(
        F.col("id").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"), (F.col("id") % 50).alias("l_partkey"),
        (F.col("id") % 9).alias("l_suppkey"), (F.col("id") * 37 + 100).alias("price_cents"), (F.col("id") * 0.37 + 1).alias(registered.TARGET),
        (F.col("id") % 50 + 1).cast("double").alias("distance_km"))
    found, reads = counted(trip)
    monkeypatch.setattr(registered, "trips", lambda spark, sf_dir, columns: found.select(*columns))
    out = registered.queries()["champion_exact"](spark, "").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"test": 600, "train": 2400}
    assert reads.value == 4 * 3000


def test_tuning_reads_its_rows_twice(few_vectors):
    """Once for their number, once to hash and keep them; the search for the cuts reads what is kept."""
    found, reads = counted(few_vectors)
    settings = training.Settings(root="", key=["id"], target="y", trials=2, parallelism=2, profiles=("forest",), spaces={
        "forest": {k: learners.Fixed(v) for k, v in FEW["tree"].params.items()}})
    got = training.tune(found, found, ["a", "b"], settings)["forest"].trials
    assert reads.value == 2 * 2000
    assert [t[1] for t in got] == [t[1] for t in training.tune(few_vectors, few_vectors, ["a", "b"], settings)["forest"].trials]
