"""Every registered query against its SQL twin; the tree queries without one against planted accuracy."""

import pytest
from check_results import connect, duck_rows, spark_rows

import __spark_entry__ as contract
from regrove.plans import oracle, registered

SQL = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(registered.queries()) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, sf, con, name):
    found = registered.queries()[name](spark, sf)
    if name in SQL:
        assert spark_rows(found) == duck_rows(con, SQL[name])
        return
    rows = found.collect()
    if "importance" in found.columns:
        assert len(rows) == 5 and abs(sum(r.importance for r in rows) - 1) < 1e-9 and rows[0].feature == "distance_km"
        return
    assert len(rows) == 6000
    errors = [(r.prediction - r.planted_target) ** 2 for r in rows if r.split == "test"]
    mean = sum(r.planted_target for r in rows) / len(rows)
    spread = [(r.planted_target - mean) ** 2 for r in rows if r.split == "test"]
    assert sum(errors) < 0.2 * sum(spread)


def test_entry(spark):
    assert contract.entry(spark).columns == ["rank", "feature", "r", "suspect"]


@pytest.mark.parametrize("rows", [registered._planted, registered._stepped])
def test_rows_of_fits_are_hashed_once(spark, sf, rows):
    found = rows(spark, sf)
    assert found.is_cached or "md5" not in found.where("split = 'train'")._jdf.queryExecution().toString()
    assert {r["split"]: r["count"] for r in found.groupBy("split").count().collect()} == {"train": 4800, "test": 1200}
