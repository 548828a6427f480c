"""Analysis of tuning trials: `study STRING, number INT, value DOUBLE, params MAP<STRING, DOUBLE>`.

Everything groups by study with map-side partial aggregates; no study is ever gathered whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIALS_SCHEMA = "study string, number int, value double, params map<string,double>"


def _of(trials: DataFrame, study: str | None) -> DataFrame:
    return trials if study is None else trials.where(F.col("study") == study)


def trial_history(trials: DataFrame, study: str | None = None) -> DataFrame:
    """Every trial with the study's best value and whether it is the best trial (lowest value, then number)."""
    rows = _of(trials, study)
    best = rows.where(F.col("value").isNotNull()).groupBy("study").agg(F.min(F.struct("value", "number")).alias("best"))
    return rows.join(best, "study", "left").select(
        "study", "number", "value", F.col("best.value").alias("best_value"),
        F.coalesce(F.col("number") == F.col("best.number"), F.lit(False)).alias("is_best"),
    )


def param_importance(trials: DataFrame, study: str | None = None) -> DataFrame:
    """|Pearson r| of every parameter with the trial value and its rank; NULL where either never varies."""
    pairs = _of(trials, study).where(F.col("value").isNotNull()).select("study", "value", F.explode("params").alias("param", "x"))
    pairs = pairs.where(F.col("x").isNotNull())
    varies = (F.min("x") < F.max("x")) & (F.min("value") < F.max("value"))
    r = F.try_divide(F.covar_pop("x", "value"), F.stddev_pop("x") * F.stddev_pop("value"))
    return (
        pairs.groupBy("study", "param").agg(F.when(varies, F.least(F.abs(r), F.lit(1.0))).alias("importance"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("study").orderBy(F.round("importance", 9).desc_nulls_last(), "param")))  # rounding noise is a tie
        .orderBy("study", "rank")
    )


def trial_points(trials: DataFrame, x: str, colour: str | None = None, study: str | None = None) -> DataFrame:
    """One parameter against the trial value, with a third value for the colour (default the trial number) and the best trial marked."""
    shade = F.col("params")[colour] if colour else F.col("number").cast("double")
    best = trial_history(trials, study).select(F.col("study").alias("s"), F.col("number").alias("n"), "is_best").where("is_best")
    rows = _of(trials, study)
    marked = rows.join(best, (F.col("study") == F.col("s")) & (F.col("number") == F.col("n")), "left")
    return marked.select("study", "number", F.col("params")[x].alias("x"), "value", shade.alias("colour"), F.coalesce("is_best", F.lit(False)).alias("is_best"))


def trial_summary(trials: DataFrame, study: str | None = None) -> DataFrame:
    """Trials, best trial and value, worst value, and the improvement of best over worst in percent."""
    best, worst = F.min("value"), F.max("value")
    return _of(trials, study).groupBy("study").agg(
        F.count(F.lit(1)).alias("trials"),
        F.min(F.when(F.col("value").isNotNull(), F.struct("value", "number")))["number"].alias("best_number"),
        best.alias("best_value"), worst.alias("worst_value"),
        (F.try_divide(worst - best, worst) * 100).alias("improvement_pct"),
    )
