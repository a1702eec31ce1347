import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.operators import quality
from wardledger.schema import NATIVE_SCHEMA
from wardledger.session import fresh_path
from wardledger.sources import landing, staging

HEADER = ",".join(NATIVE_SCHEMA.fieldNames())
GOOD = "1,A,B,NY,60,2023-12-31,10.5,30.0,-2.5,1,2,3,4,5"


def csv_file(tmp_path, *lines, header=HEADER):
    path = tmp_path / "in.csv"
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_columns_bind_by_position(spark, tmp_path):
    path = csv_file(tmp_path, GOOD, header=HEADER.replace("provider_id,hospital_name", "x,y"))
    row = staging.read_external(spark, path).first()
    assert (row.provider_id, row.beds, str(row.reporting_period_end)) == (1, 60, "2023-12-31")
    native = staging.native_names(staging.read_external(spark, path))
    assert native.columns == NATIVE_SCHEMA.fieldNames()


def test_a_bad_row_fails_the_read(spark, tmp_path):
    path = csv_file(tmp_path, GOOD, GOOD.replace("2023-12-31", "not a date"))
    with pytest.raises(Exception, match="Malformed records"):
        staging.read_csv(spark, path).collect()


def test_a_null_id_fails_the_load_and_commits_nothing(spark, tmp_path):
    path = csv_file(tmp_path, GOOD, GOOD[1:])
    target = fresh_path(spark, "load")
    with pytest.raises(PySparkException, match="provider_id"):
        staging.load_staging(spark, path, target)
    with pytest.raises(PySparkException):
        spark.read.parquet(target).collect()


def test_load_appends_and_truncates(spark, tmp_path):
    path = csv_file(tmp_path, GOOD)
    target = fresh_path(spark, "load")
    assert staging.load_staging(spark, path, target).count() == 1
    assert staging.load_staging(spark, path, target, "append").count() == 2
    assert staging.load_staging(spark, path, target).count() == 1


def test_copies_are_not_removed(spark, tmp_path, reports):
    stg = reports([(1, 2023, 60, 10.0, 1.0), (2, 2022, 60, 10.0, 2.0)])
    path = fresh_path(spark, "copies")
    for copy in range(8):
        staging.write_csv(stg, f"{path}/{copy}")
    read = staging.read_csv(spark, f"{path}/*/*.csv")
    assert read.count() == 16
    assert read.agg(F.sum("net_income")).first()[0] == 24.0


def many(reports, days=3, providers=2000):
    return reports([(p, 2020 + p % days, 60, 10.0, 1.0) for p in range(providers)])


def test_staging_files_are_sorted_by_provider(spark, reports):
    path = fresh_path(spark, "sorted")
    staging.write_staging(many(reports), path)
    read = staging.read_staging(spark, path)
    assert read.count() == 2000
    in_file = read.select(F.input_file_name().alias("f"), "provider_id").collect()
    files = {}
    for row in in_file:
        files.setdefault(row.f, []).append(row.provider_id)
    assert len(files) >= 3
    assert all(ids == sorted(ids) for ids in files.values())


def test_a_large_date_is_split_over_tasks(spark, reports):
    """A date with most rows is not written by one task."""
    keys = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    try:
        path = fresh_path(spark, "skewed")
        hot = reports([(p, 2023, 60, float(p), 1.0) for p in range(8000)]).repartition(8)
        staging.write_staging(hot, path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = landing.list_files(spark, path).filter(F.col("path").endswith(".parquet"))
    assert files.count() > 3
    assert staging.read_staging(spark, path).count() == 8000


def test_recreate_replaces_the_table(spark, reports):
    first = reports([(1, 2023, 60, 10.0, 1.0)])
    second = reports([(2, 2022, 60, 10.0, 1.0), (3, 2021, 60, 10.0, 1.0)])
    for df in (first, second):
        table = staging.recreate_table(
            df, "test_recreated", fresh_path(spark, "table"), ["report_period"])
    assert sorted(rows(table.select("provider_id"))) == [(2,), (3,)]
    assert spark.sql("SHOW PARTITIONS test_recreated").count() == 2
    counts = staging.partition_counts({"test_recreated": table})
    assert sorted(r.records for r in counts.collect()) == [1, 1]


def test_a_failed_replacement_keeps_the_old_table(spark, reports):
    good = reports([(1, 2023, 60, 10.0, 1.0)])
    staging.recreate_table(good, "test_kept", fresh_path(spark, "table"), [])
    bad = quality.enforce_required(reports([(None, 2023, 60, 10.0, 1.0)]))
    with pytest.raises(Exception, match="provider_id"):
        staging.recreate_table(bad, "test_kept", fresh_path(spark, "table"), [])
    assert rows(spark.table("test_kept").select("provider_id")) == [(1,)]


def test_newest_batch_is_not_the_last_name(spark, reports):
    path = fresh_path(spark, "landing")
    names = [
        "hospital_cost_sample_500rows_20250101_000000",
        "hospital_cost_sample_100rows_20250909_092637",
        "hospital_cost_sample_300rows_20250303_101010",
    ]
    for i, name in enumerate(names, start=1):
        stg = reports([(p, 2023, 60, 1.0, 1.0) for p in range(i)])
        landing.land(stg.withColumn("batch_name", F.lit(name)), path)
    found = landing.latest_batch(spark, path).first()
    assert (found.batch_name, str(found.batch_ts), found.rows) == (names[1], "2025-09-09 09:26:37", 2)
    assert landing.read_landing(spark, path).count() == 6


def test_storage_metadata(spark, reports):
    path = fresh_path(spark, "meta")
    staging.write_staging(many(reports), path)
    files = landing.storage_metrics(spark, path).collect()
    assert all(f.size_bytes > 0 and f.size_mb == f.size_bytes / 1024 / 1024 for f in files)
    table = landing.table_storage(spark, path, staging.read_staging(spark, path)).first()
    assert (table.num_rows, table.physical_bytes) == (2000, sum(f.size_bytes for f in files))


def test_quality_report(reports):
    good = reports([(1, 2023, 60, 10.0, 1.0), (2, 2023, 60, 10.0, 1.0)])
    assert all(r.passed for r in quality.quality_report(good).collect())
    bad = reports([(1, 2023, 0, 10.0, 1.0), (1, 2023, 60, None, 1.0), (2, 2023, -1, None, 1.0)])
    assert rows(quality.quality_report(bad)) == [
        ("required_columns", 0, True),
        ("unique_provider_id", 1, False),
        ("positive_beds", 2, False),
        ("expenses_present", 2, False),
    ]
    missing = quality.quality_report(good.drop("net_income", "beds_number"))
    assert rows(missing) == [("required_columns", 2, False)]
    empty = quality.quality_report(good.limit(0)).collect()
    assert [r.failed_rows for r in empty] == [0, 0, 0, 0]


def test_required_violations(reports):
    stg = reports([(1, 2023, 60, None, 1.0), (2, None, 60, None, 1.0)])
    found = dict(rows(quality.required_violations(stg)))
    assert found["total_expenses"] == 2
    assert found["report_period"] == 1
    assert found["provider_id"] == 0


def test_reconciliation_counts_copies(reports):
    source = reports([(1, 2023, 60, 1.0, 1.0)] * 3 + [(2, 2023, 60, 1.0, None)])
    target = reports([(1, 2023, 60, 1.0, 1.0)] + [(3, 2023, 60, 1.0, 1.0)] * 2)
    assert rows(quality.load_reconciliation(source, target)) == [(4, 3, 3, 2)]
    assert rows(quality.load_reconciliation(source, source)) == [(4, 4, 0, 0)]
    assert rows(quality.load_reconciliation(source.limit(0), target.limit(0))) == [(0, 0, 0, 0)]


def test_connection_probe(spark):
    assert rows(staging.connection_probe(spark)) == [(1, "connection_test")]


def test_newest_batch_of_any_name(spark):
    def newest(*names):
        files = spark.createDataFrame([(f"file:/x/{n}",) for n in names], "path string")
        return landing.newest_batch(files).first().batch_name

    again = "hospital_cost_sample_5rows_20250101_000000_20260202_101010"
    assert newest("hospital_cost_sample_9rows_20260101_000000.csv", f"{again}.csv", "other_20270101_000000.csv") == again
    assert newest("hospital_cost_sample.csv", "hospital_cost_sample_x_20200101_000000.csv") == "hospital_cost_sample_x_20200101_000000"
    assert newest("batch_name=hospital_cost_sample_a_20250101_000000/p.csv", "batch_name=hospital_cost_sample_b_20250101_000000/p.csv") == "hospital_cost_sample_b_20250101_000000"
    assert newest("hospital_cost_sample.csv") == "hospital_cost_sample"


def test_files_of_a_split_date_hold_ranges_of_providers(spark, reports, tmp_path):
    df = reports([(i, 2020, 60, 1.0, 1.0) for i in range(400)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staging.write_staging(df, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(str(tmp_path / "t")).groupBy("_metadata.file_path").agg({"provider_id": "min"}).count()
    ranges = sorted(
        (r.low, r.high)
        for r in spark.read.parquet(str(tmp_path / "t")).groupBy("_metadata.file_path")
        .agg(F.min("provider_id").alias("low"), F.max("provider_id").alias("high")).collect()
    )
    assert files > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
