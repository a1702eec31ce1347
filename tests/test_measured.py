"""Figures that loads, scans and comparisons of loads take from the work itself."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from tests.conftest import rows
from wardledger.functions.sizes import logical_bytes
from wardledger.operators import quality
from wardledger.schema import NATIVE_SCHEMA
from wardledger.session import fresh_path
from wardledger.sources import landing, scans, staging


def test_logical_bytes_by_type(spark):
    schema = T.StructType([
        T.StructField("flag", T.BooleanType()), T.StructField("n", T.IntegerType()), T.StructField("day", T.DateType()),
        T.StructField("amount", T.DecimalType(10, 2)), T.StructField("text", T.StringType()), T.StructField("raw", T.BinaryType()),
    ])
    day = datetime.date(2023, 1, 1)
    full = (True, 1, day, None, "", None)
    df = spark.createDataFrame([(True, 1, day, None, "zwölf", b"abc"), (None,) * 6, full], schema)
    assert [r[0] for r in df.select(logical_bytes(df.schema)).collect()] == [1 + 8 + 8 + 6 + 2 + 3, 0, 1 + 8 + 8 + 2]
    assert [r[0] for r in df.select(logical_bytes(df.schema, ["n", "text"])).collect()] == [16, 0, 10]
    with pytest.raises(TypeError, match="array"):
        logical_bytes(spark.range(1).select(F.array("id").alias("a")).schema)


def many(reports, n=300):
    return reports([(i % 50, 2020 + i % 3, 60 + i % 5, float(i), None if i % 4 else 1.0) for i in range(n)])


def test_a_load_counts_each_row_once(spark, reports):
    df = many(reports).repartition(7)
    path = fresh_path(spark, "load")
    load = staging.write_measured(df, path, scanned=["state", "beds_number"])
    assert (load.rows, load.periods, load.scanned_bytes) == (300, 3, 300 * (4 + 8))
    assert load.logical_bytes == df.agg(F.sum(logical_bytes(df.schema))).first()[0]
    assert load.null_values["net_income"] == 225 and load.null_values["provider_id"] == 0
    back = staging.read_staging(spark, path)
    assert sorted(rows(back.select(*df.columns)), key=str) == sorted(rows(df), key=str)
    more = staging.write_measured(many(reports, 10), path, "append")
    assert more.rows == 10 and staging.read_staging(spark, path).count() == 310


def test_a_measured_load_keeps_the_order_of_its_files(spark, reports):
    path = fresh_path(spark, "load")
    staging.write_measured(many(reports).repartition(5, "city", "net_income"), path)
    found = spark.read.schema(NATIVE_SCHEMA).parquet(path).select(F.input_file_name(), "provider_id").collect()
    by_file = {}
    for name, provider in found:
        by_file.setdefault(name, []).append(provider)
    assert all(ids == sorted(ids) for ids in by_file.values())


def test_an_empty_load_and_a_missing_id(spark, reports):
    load = staging.write_measured(many(reports).limit(0), fresh_path(spark, "load"))
    assert load[:4] == (0, 0, 0, 0) and set(load.null_values.values()) == {0}
    with pytest.raises(PySparkException, match="provider_id"):
        staging.write_measured(reports([(None, 2023, 60, 1.0, 1.0)]), fresh_path(spark, "load"))


def test_table_storage(spark, reports):
    path = fresh_path(spark, "stored")
    load = staging.write_measured(many(reports), path)
    found = landing.table_storage(spark, path, staging.read_staging(spark, path)).first()
    assert (found.num_rows, found.num_partitions, found.logical_bytes) == (load.rows, load.periods, load.logical_bytes)
    assert found.compression_ratio == found.physical_bytes / found.logical_bytes
    assert found.logical_mb == found.logical_bytes / 2**20 and found.files >= 3
    empty = landing.table_storage(spark, path, staging.read_staging(spark, path).limit(0)).first()
    assert (empty.num_rows, empty.num_partitions, empty.logical_bytes, empty.compression_ratio) == (0, 0, 0, 0.0)


def test_a_filter_on_the_date_reads_its_partitions_only(spark, reports):
    path = fresh_path(spark, "scan")
    staging.write_staging(many(reports), path)
    sizes = {}
    for f in landing.list_files(spark, path).collect():
        sizes.setdefault(f.path.split("report_period=")[1][:4], []).append(f.length)
    stg = staging.read_staging(spark, path)
    found = scans.scan_reduction(stg, F.col("report_period") == F.lit("2021-12-31").cast("date")).first()
    assert (found.total_files, found.total_bytes) == (sum(map(len, sizes.values())), sum(map(sum, sizes.values())))
    assert (found.kept_files, found.kept_bytes) == (len(sizes["2021"]), sum(sizes["2021"]))
    assert (found.total_partitions, found.kept_partitions, found.total_rows, found.kept_rows) == (3, 1, 300, 100)
    assert found.bytes_saved_pct == round((found.total_bytes - found.kept_bytes) / found.total_bytes * 100, 1)
    none = scans.scanned(stg.filter(F.col("report_period") == F.lit("1999-12-31").cast("date")))
    assert (none.files, none.file_bytes, none.rows) == (0, 0, 0)


def test_scans_of_all_sides_of_a_join_are_added(spark, reports):
    path = fresh_path(spark, "scan")
    staging.write_staging(many(reports), path)
    stg = staging.read_staging(spark, path)
    one = scans.scanned(stg)
    other = stg.groupBy("provider_id").agg(F.count("*").alias("n"))
    two = scans.scanned(stg.select("provider_id", "beds_number").join(other, "provider_id"))
    assert (two.files, two.rows) == (2 * one.files, 300)


def test_cells_find_what_a_whole_comparison_finds(spark, reports):
    source = many(reports).withColumn("provider_id", F.col("provider_id") * 10)
    damages = {
        "lost": source.filter("NOT (provider_id = 130 AND report_period = '2021-12-31')"),
        "doubled": source.unionByName(source.filter("provider_id = 130")),
        "null moved": source.withColumn("hospital_name", F.when(F.col("provider_id") != 130, F.col("hospital_name"))),
        "same": source.orderBy("net_income"),
        "all gone": source.limit(0),
    }
    for target in damages.values():
        whole = quality.load_reconciliation(source, target).first()
        found = quality.reconcile_cells(source, target, width=100).first()
        assert tuple(found)[:4] == tuple(whole)
        assert (found.cells_differing == 0) == (whole.missing == whole.extra == 0)
    assert quality.reconcile_cells(source, damages["lost"], width=100).first().cells_differing == 1


def test_a_null_that_changes_its_column_is_seen(reports):
    row = (1, "x", None, "NY", 60, datetime.date(2023, 12, 31), 1.0, 3.0, 1.0, 1, 2, 3, 4, 5)
    other = (1, None, "x", *row[3:])
    spark = reports([(1, 2023, 60, 1.0, 1.0)]).sparkSession
    source, target = (spark.createDataFrame([r], NATIVE_SCHEMA) for r in (row, other))
    assert tuple(quality.reconcile_cells(source, target).first()) == (1, 1, 1, 1, 1, 1)


def test_cells_with_null_keys_and_empty_sides(reports):
    source = reports([(None, 2023, 60, 1.0, 1.0), (1, None, 60, 1.0, 1.0), (-1, 2023, 60, 1.0, 1.0)])
    assert tuple(quality.reconcile_cells(source, source).first()) == (3, 3, 0, 0, 3, 0)
    target = source.withColumn("beds_number", F.when(F.col("provider_id").isNull(), 61).otherwise(F.col("beds_number")))
    assert tuple(quality.reconcile_cells(source, target).first()) == (3, 3, 1, 1, 3, 1)
    none = source.limit(0)
    assert tuple(quality.reconcile_cells(none, none).first()) == (0, 0, 0, 0, 0, 0)
