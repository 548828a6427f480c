from regrove.plans.exploration import profile_table, write_report
from regrove.sources.trips import trips
from regrove.operators.features import row_features


def test_every_table_of_the_report(spark, sf, tmp_path):
    report = profile_table(row_features(trips(spark, sf)))
    assert report.target_status == "ok" and report.exclusions == ["price_cents"]
    write_report(report, str(tmp_path))
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in report.tables}
    assert read["shape"].first().n_rows == 6000
    assert read["correlation_top"].count() == 15 and read["correlation_matrix"].count() == 144
    assert read["target_histogram"].count() == 50
    assert {r.column for r in read["presence"].where("not present").collect()} == {"vehicle_efficiency_vs_fleet"}
    assert {"scatter_distance_km", "scatter_avg_speed_kmh", "scatter_elevation_gain_m", "leaks", "missing"} <= set(read)


def test_report_without_a_usable_target(spark):
    nothing = profile_table(spark.createDataFrame([(1, None)], "a int, target_energy_consumption double"))
    assert nothing.target_status == "all_null" and nothing.tables["target"].first().all_null
    assert "correlation" not in nothing.tables
    assert profile_table(spark.range(3)).target_status == "no_column"
