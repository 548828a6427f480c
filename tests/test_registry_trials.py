import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from regrove.plans import learners, registry, trials
from regrove.plans.registry import Run
from regrove.session import scratch_path, shared_dir


@pytest.fixture()
def runs(spark, tmp_path):
    path = str(tmp_path / "log")
    for run in (
        Run("b", metrics={"test_rmse": 2.0, "test_r2": 0.5}, run_id="2"),
        Run("a", metrics={"test_rmse": 2.0, "test_r2": 0.6}, run_id="1", params={"depth": 3}, tags={"t": "x"}, features=["f"]),
        Run(None, metrics={"test_rmse": None}, run_id="3"),
        Run("c", metrics={"test_rmse": 9.0}, run_id="4"),
    ):
        registry.log_run(spark, path, run)
    return registry.read_runs(spark, path)


def test_runs_are_ordered_with_missing_last(runs):
    assert [r.run_id for r in registry.search_runs(runs).collect()] == ["1", "2", "4", "3"]
    best = registry.best_run(runs).first()
    assert best.run_id == "1" and best.params == {"depth": "3"} and best.features == ["f"]


def test_comparison_fills_what_a_run_lacks(runs):
    rows = {r.run_id: r for r in registry.compare_runs(runs).collect()}
    assert rows["3"].run_name == "Unknown" and rows["3"].test_rmse == math.inf and rows["3"].test_r2 == 0.0
    assert rows["4"].test_r2 == 0.0


def test_no_log_yet(spark, tmp_path):
    nothing = registry.read_runs(spark, str(tmp_path / "none"))
    assert registry.best_run(nothing).collect() == []


def save(path, value):
    PipelineModel([SQLTransformer(statement=f"SELECT *, {value} AS prediction FROM __THIS__")]).write().overwrite().save(path)
    return path


def test_versions_alias_and_scoring(spark, tmp_path):
    models = registry.Registry(spark, str(tmp_path))
    first = models.promote("m", {"run_id": "r1", "model_path": save(str(tmp_path / "one"), 1)}, {"k": "v"})
    assert first == registry.Registration("m", 1)
    assert models.score("m", spark.range(2)).first().prediction == 1
    second = models.promote("m", {"run_id": "r2", "model_path": save(str(tmp_path / "two"), 2)})
    assert second.version == 2 and models.score("m", spark.range(2)).first().prediction == 2
    models.set_alias("m", registry.CHAMPION, 1)
    assert models.score("m", spark.range(1)).first().prediction == 1
    assert [tuple(r) for r in models.aliases().collect()] == [("m", "champion", 1)]
    assert models.register("other", "r3", str(tmp_path / "one")) == 1


def test_several_writers_get_versions_of_their_own_and_one_alias_holder(spark, tmp_path):
    path = save(str(tmp_path / "model"), 1)
    tasks = [lambda i=i: registry.Registry(spark, str(tmp_path)).promote("a.b/c", {"run_id": f"r{i}", "model_path": path}) for i in range(8)]
    done = learners.in_threads(spark, tasks, 8)
    assert sorted(d.version for d in done) == list(range(1, 9)) and not any(d.error for d in done)
    models = registry.Registry(spark, str(tmp_path))
    assert sorted((r.version, r.run_id) for r in models.models().select("version", "run_id").collect()) == sorted((d.version, f"r{i}") for i, d in enumerate(done))
    events = {r.number: r.version for r in models.alias_events().collect()}
    assert sorted(events) == list(range(1, 9))
    assert [tuple(r) for r in models.aliases().collect()] == [("a.b/c", "champion", events[8])]
    assert models.register("a.b/c", "next", path) == 9


def test_a_claim_is_held_by_one_writer(spark, tmp_path):
    taken = learners.in_threads(spark, [lambda: registry.claim(spark, f"{tmp_path}/claims/1") for _ in range(16)], 16)
    assert sum(taken) == 1
    assert registry.claim_next(spark, f"{tmp_path}/claims", 1) == 2


def test_runs_of_several_writers_are_all_logged(spark, tmp_path):
    ids = learners.in_threads(spark, [lambda i=i: registry.log_run(spark, f"{tmp_path}/log", Run(f"n{i}")) for i in range(8)], 8)
    assert sorted(r.run_id for r in registry.read_runs(spark, f"{tmp_path}/log").collect()) == sorted(ids)


def test_failures_are_reported(spark, tmp_path):
    models = registry.Registry(spark, str(tmp_path))
    lost = models.promote("m", {"run_id": "r", "model_path": str(tmp_path / "missing")})
    assert lost.version is None and lost.error
    assert models.models().collect() == []
    with pytest.raises(LookupError):
        models.load("m")
    with pytest.raises(ValueError):
        models.set_alias("m", "champion", 3)


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.fixture(scope="module")
def study(spark):
    rng = np.random.default_rng(5)
    rows = [("s", i, float(rng.normal(5, 1)), {"depth": float(rng.integers(4, 11)), "lr": float(rng.random()), "fixed": 1.0})
            for i in range(25)]
    rows[7] = ("s", 7, 0.5, rows[7][3])
    rows[9] = ("s", 9, 0.5, rows[9][3])
    return rows, spark.createDataFrame(rows + [("t", 0, None, {"depth": 1.0}), ("t", 1, 2.0, {"depth": 2.0})], trials.TRIALS_SCHEMA)


def test_history_and_summary(study):
    rows, df = study
    history = trials.trial_history(df, "s").collect()
    assert [r.number for r in history if r.is_best] == [7] and {r.best_value for r in history} == {0.5}
    s = {r.study: r for r in trials.trial_summary(df).collect()}
    worst = max(r[2] for r in rows)
    assert (s["s"].trials, s["s"].best_number, s["s"].best_value, s["s"].worst_value) == (25, 7, 0.5, worst)
    assert math.isclose(s["s"].improvement_pct, (worst - 0.5) / worst * 100)
    assert s["t"].trials == 2 and s["t"].best_number == 1
    assert [r.number for r in trials.trial_history(df, "t").collect() if r.is_best] == [1]


def test_param_importance(study):
    rows, df = study
    got = {r.param: r.importance for r in trials.param_importance(df, "s").collect()}
    values = [r[2] for r in rows]
    for p in ("depth", "lr"):
        assert math.isclose(got[p], abs(np.corrcoef([r[3][p] for r in rows], values)[0, 1]), rel_tol=1e-9)
    assert got["fixed"] is None


def test_points(study):
    rows, df = study
    got = {r.number: r for r in trials.trial_points(df, "depth", study="s").collect()}
    assert got[3].x == rows[3][3]["depth"] and got[3].colour == 3.0
    assert trials.trial_points(df, "lr", "depth", "s").first().colour == rows[0][3]["depth"]
