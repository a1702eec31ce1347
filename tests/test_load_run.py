import datetime

import pytest

from tests.conftest import rows
from wardledger.operators import benchmark, cost, metrics, profile, yearly
from wardledger.plans import load_run
from wardledger.session import fresh_path
from wardledger.sources import landing, staging

AT = datetime.datetime(2025, 9, 9, 9, 26, 37)


def test_sample_to_report(spark):
    folder = fresh_path(spark, "landing")
    files = load_run.land_sample(spark, 200, folder, AT)
    assert "hospital_cost_sample_200rows_20250909_092637" in files
    assert landing.latest_batch(spark, folder).first().rows == 200

    run = load_run.load(spark, files, fresh_path(spark, "table"))
    assert rows(run.profile["total_records"]) == [(200,)]
    assert sum(r.hospitals for r in run.profile["year_distribution"].collect()) == 200
    result = run.results.first()
    assert (result.num_rows, result.num_partitions) == (200, 4)
    assert result.raw_csv_mb > 0 and result.physical_mb > 0
    assert result.compression_ratio == pytest.approx(result.physical_mb / result.logical_mb)
    assert result.data_load_seconds > 0 and result.data_load_memory_mb > 0
    assert result.data_generation_seconds == 0
    parts = [result[f"{name}_usd"] for name in cost.COMPONENTS]
    assert result.total_usd == pytest.approx(sum(parts)) and result.query_usd > 0
    stored = landing.table_storage(spark, run.path, run.table).first()
    assert (stored.logical_mb, stored.physical_mb) == (result.logical_mb, result.physical_mb)

    long = metrics.csv_roundtrip(metrics.long_form(run.results))
    assert long.count() == 18
    assert dict(rows(long.select("metric_name", "metric_value")))["Row_Count"] == "200"


def test_layouts_are_compared_on_equal_results(spark):
    files = load_run.land_sample(spark, 100, fresh_path(spark, "landing"), AT)
    native = load_run.load(spark, files, fresh_path(spark, "table")).table
    external = staging.native_names(staging.read_external(spark, files))
    assert rows(yearly.flagship(native)) == rows(yearly.flagship(external))
    runs = load_run.compare_layouts(native, external, 2023, (100020, 100040), iterations=2)
    assert runs.count() == 12
    assert benchmark.benchmark_summary(runs).count() == 3
    overall = benchmark.benchmark_overall(runs).first()
    assert (overall.native_ok, overall.external_ok) == (6, 6)


def test_a_failed_check_stops_the_sample(spark, monkeypatch):
    monkeypatch.setattr(load_run.generate, "synthetic_hospitals",
                        lambda spark, rows, seed: load_run.generate.generate(
                            spark.range(2).selectExpr("0L AS id"), seed))
    with pytest.raises(ValueError, match="unique_provider_id"):
        load_run.land_sample(spark, 2, fresh_path(spark, "landing"), AT)


def test_generation_is_timed_when_it_is_part_of_the_run(spark):
    run = load_run.generate_and_load(spark, 50, fresh_path(spark, "landing"), fresh_path(spark, "table"), AT)
    result = run.results.first()
    assert result.data_generation_seconds > 0 and result.data_generation_memory_mb > 0
    assert result.num_rows == 50


def test_the_profile_reads_the_columns_it_says(spark, monkeypatch):
    files = load_run.land_sample(spark, 20, fresh_path(spark, "landing"), AT)
    read = []
    monkeypatch.setattr(profile, "materialise", lambda df, label: read.append(df) or df)
    profile.staging_profile(load_run.load(spark, files, fresh_path(spark, "table")).table)
    scan = read[-1]._jdf.queryExecution().executedPlan().toString()
    schema = scan.split("ReadSchema: struct<")[1].split(">")[0]
    names = {part.split(":")[0] for part in schema.split(",")} | {"report_period"}
    assert names == set(profile.PROFILE_COLUMNS)
