import hashlib
from collections import Counter
from math import ceil

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from regrove.operators import selection, split

SLOW = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "skewed", "constant"])
def test_exact_quantiles_match_numpy(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "normal": rng.normal(size=3000), "ties": rng.integers(0, 9, 3000).astype(float),
        "two": np.repeat([0.0, 1.0], 1500), "constant": np.full(500, 7.0),
        "skewed": np.concatenate([np.full(2500, 4.0), np.exp(rng.normal(size=500) * 20)]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": rng.permutation(values)})).repartition(5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = selection.exact_quantiles(df, "v", probs)
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12)


@pytest.mark.parametrize("values", [[1, 1, 1, 1, 2, 3, 3, 9], [5, 5, 5], [1, 2, 3, 4], list(range(100)), [1, 1, 1, 1, 2]])
def test_quantile_label_matches_qcut(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "y double")
    got = selection.quantile_label(df, "y").where("y is not null").toPandas()
    expected = pd.qcut(got.y, q=4, labels=False, duplicates="drop").fillna(0).astype(int)
    assert list(got.label) == list(expected)
    assert selection.quantile_label(df, "y").where("y is null").first().label is None


def test_quantile_label_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "y double")
    assert selection.quantile_label(df, "y").first().label is None


def counted(spark, n):
    """A frame of n rows, and the rows of it that tasks have read so far."""
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    return spark.range(0, n, 1, 4).mapInArrow(read, "id long"), reads


@pytest.mark.parametrize("n", [100, 40_000])
def test_quantiles_and_cuts_read_their_source_twice(spark, n):
    df, reads = counted(spark, n)
    assert selection.exact_quantiles(df, "id", [0.25, 0.5, 0.75]) == [x * (n - 1) for x in (0.25, 0.5, 0.75)]
    assert reads.value <= 2 * n
    df, reads = counted(spark, n)
    folded = split.kfold(df, ["id"], 5, 42)
    assert reads.value <= 2 * n
    assert sorted(r["count"] for r in folded.groupBy("fold").count().collect()) == [n // 5] * 5


def test_too_many_strata_are_refused(spark, monkeypatch):
    monkeypatch.setattr(split, "MAX_STRATA", 0)
    with pytest.raises(ValueError, match="few classes"):
        split.kfold(spark.range(10), ["id"])


def hash_order(seed, ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}|{i}".encode()).hexdigest())


def test_kfold_follows_hash_order(spark):
    df = spark.range(0, 1003, 1, 6)
    folds = {r.id: r.fold for r in split.kfold(df, ["id"], 5, 42).collect()}
    expected, start = {}, 0
    for fold in range(5):
        size = 1003 // 5 + (fold < 1003 % 5)
        expected.update({i: fold for i in hash_order(42, range(1003))[start:start + size]})
        start += size
    assert folds == expected


@SLOW
@given(sizes=st.lists(st.integers(0, 60), min_size=1, max_size=4), seed=st.integers(0, 5))
def test_split_sizes(spark, sizes, seed):
    rows = [(s * 1000 + i, s) for s, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label int")
    out = split.stratified_split(df, "label", ["id"], 0.2, seed).collect()
    n = len(rows)
    assert len(out) == n
    tested = Counter(r.label for r in out if r.split == "test")
    counts = {s: c for s, c in enumerate(sizes) if c > 1}
    n_test = min(ceil(round(0.2 * n, 9)), sum(counts.values()))
    assert sum(tested.values()) == n_test
    total = sum(counts.values())
    for s, c in counts.items():
        assert abs(tested[s] - n_test * c / total) < 1
    for s, c in enumerate(sizes):
        if c == 1:
            assert tested[s] == 0


def test_split_does_not_depend_on_partitioning(spark):
    df = spark.range(5000).withColumn("label", (F.col("id") % 3).cast("int"))
    def one(d):
        return {r.id for r in split.stratified_split(d, "label", ["id"]).where("split = 'test'").collect()}
    assert one(df.repartition(1)) == one(df.repartition(11)) == one(df.orderBy(F.desc("id")))
    assert one(df) != {r.id for r in split.stratified_split(df, "label", ["id"], seed=7).where("split = 'test'").collect()}


def test_copies_are_cut_exactly_and_kept_whole(spark):
    """A third of all rows are copies of one row; cuts run through them."""
    unique = spark.range(600).select(F.col("id").alias("k"), F.lit(1.5).alias("v"))
    copies = spark.range(300).select(F.lit(7777).cast("long").alias("k"), F.lit(2.5).alias("v"))
    df = unique.unionByName(copies)
    for k in (2, 5, 9):
        out = split.kfold(df, ["k"], k)
        assert out.columns == ["k", "v", "fold"]
        sizes = Counter(r.fold for r in out.collect())
        assert sum(sizes.values()) == 900 and max(sizes.values()) - min(sizes.values()) <= 1
        assert out.where("k = 7777 and v = 2.5").count() == 300
    labelled = df.withColumn("label", F.when(F.col("k") == 7777, 1).otherwise(0))
    out = split.stratified_split(labelled, "label", ["k"])
    assert Counter((r.label, r.split) for r in out.collect()) == {
        (0, "train"): 480, (0, "test"): 120, (1, "train"): 240, (1, "test"): 60}


def test_equal_keys_are_ordered_by_the_whole_row(spark):
    df = spark.range(400).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    first = {r.v: r.fold for r in split.kfold(df, ["k"], 4).collect()}
    again = {r.v: r.fold for r in split.kfold(df.repartition(9), ["k"], 4).collect()}
    assert first == again and set(Counter(first.values()).values()) == {100}


def test_small_and_empty_frames(spark):
    empty = spark.createDataFrame([], "id long, label int, y double")
    assert split.stratified_split(empty, "label", ["id"]).collect() == []
    assert split.kfold(empty, ["id"]).columns == ["id", "label", "y", "fold"]
    two = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(r.fold for r in split.kfold(two, ["id"], 5).collect()) == [0, 1]


def test_split_summary(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("train", None), ("test", 5.0)], "split string, y double")
    rows = {r.split: r for r in split.split_summary(df, "y").collect()}
    assert rows["train"].n == 3 and rows["train"].pct == 75.0 and rows["train"].target_mean == 2.0
    assert rows["test"].target_std is None


def test_first_count_of_all_rows_does_not_sort_them(spark):
    rows = spark.range(5000).select(F.lit(0).alias("stratum"), split.row_hash(["id"], 42).alias("h"))
    counts = split._counts(rows, 0)
    assert "Sort" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sum(r.n for r in counts.collect()) == 5000


@pytest.mark.parametrize("n", [300, 20_000])
def test_even_hashes_are_cut_without_counting_prefixes(spark, monkeypatch, n):
    """One pass hashes the rows; only cuts that aren't where even hashes have them need the prefixes."""
    asked = []
    find = split._find_cuts
    monkeypatch.setattr(split, "_find_cuts", lambda rows, first, wanted: asked.append(len(wanted)) or find(rows, first, wanted))
    df = spark.range(n).withColumn("label", F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int"))
    tested = split.stratified_split(df, "label", ["id"]).where("split = 'test'").groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in tested} == {k: n // 20 for k in (None, 1, 2, 3)}
    assert sorted(r["count"] for r in split.kfold(df, ["id"]).groupBy("fold").count().collect()) == [n // 5] * 5
    assert not asked
    lumpy = df.withColumn("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    assert sorted(r["count"] for r in split.kfold(lumpy, ["id"]).groupBy("fold").count().collect()) == [n // 5] * 5
    assert asked or n == 300  # there the windows hold every hash


def test_a_row_is_hashed_once_per_pass(spark):
    rows = spark.range(50).select(F.lit(0).alias("stratum"), split.row_hash(["id"], 42).alias("h"))
    plan = split._near(rows, split._windows([(0, 10), (0, 40)], {0: 50}))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1


@pytest.mark.parametrize("n", [400, 40_000])
def test_kept_rows_are_hashed_on_their_way_alone(spark, n):
    """One read for the sizes, one for the rows that are kept; the parts are those that unkept rows get."""
    expected = {r["id"]: r["fold"] for r in split.kfold(spark.range(n), ["id"], 5, 42).collect()}
    df, reads = counted(spark, n)
    kept = []

    def store(rows):
        kept.append(rows.persist())
        return kept[-1]

    folded = split.kfold(df, ["id"], 5, 42, store=store)
    assert {r["id"]: r["fold"] for r in folded.collect()} == expected
    assert reads.value == 2 * n and len(kept) == 1 and folded.columns == ["id", "fold"]
    kept[0].unpersist()


@pytest.mark.parametrize("frame", ["copies", "one_key", "few", "none", "classes"])
def test_kept_rows_get_the_parts_of_unkept_rows(spark, tmp_path, frame):
    """Torn cuts, cuts outside their windows, few rows and none, null classes; a column that is dropped on the way still orders equal keys."""
    df = {
        "copies": spark.range(900).select((F.col("id") % 7).alias("id"), F.lit("x").alias("v"), F.lit(0).alias("label")),
        "one_key": spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(0).alias("id"), F.col("id").cast("string").alias("v"), F.lit(1).alias("label")),
        "few": spark.createDataFrame([(1, "a", 0), (2, None, None)], "id long, v string, label int"),
        "none": spark.createDataFrame([], "id long, v string, label int"),
        "classes": spark.range(3000).select("id", F.lit("x").alias("v"), F.when(F.col("id") % 4 > 0, F.col("id") % 4).cast("int").alias("label")),
    }[frame]
    written = []

    def store(rows):
        written.append(f"{tmp_path}/{len(written)}")
        rows.drop("v", "label").write.parquet(written[-1])
        return spark.read.schema(rows.drop("v", "label").schema).parquet(written[-1])

    rows = split.stratified_split(df, "label", ["id"], store=store)
    assert rows.columns == ["id", "split"]
    expected = split.stratified_split(df, "label", ["id"]).select("id", "split")
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, expected.collect()))
    assert len(written) == (2 if frame in ("copies", "one_key") else 1)
