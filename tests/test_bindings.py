"""The cost reports behind the queries, from small tables built here."""

import glob
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.functions import money
from wardledger.plans import bindings
from wardledger.sources import staging

ODD = [0.1, 1.005, 2.675, -1.005, 33.33, 0.0, -0.0, 123456.785, 99999999.99, 12.3456789, 1e-9, None]


@pytest.fixture
def sf_dir(spark, tmp_path):
    orders = [(i, i % 4, 1000.5 + i, f"{1996 + i % 3}-05-06 00:00:00") for i in range(len(ODD))]
    lines = [(i, x, d) for i, x in enumerate(ODD) for d in (0.05, 0.005, None, 0.1)]
    tables = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
        .withColumn("o_orderdate", F.to_timestamp_ntz("o_orderdate")),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_discount double"),
        "customer": spark.createDataFrame(
            [(i, f"c{i}", "CITY", 0) for i in range(4)], "c_custkey long, c_name string, c_mktsegment string, c_nationkey int"),
        "nation": spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def _files(glob_path):
    return glob.glob(re.sub("^file:/*", "/", glob_path))


def test_copies_are_compressed_and_whole(spark, sf_dir):
    copies = bindings.external_copies(spark, sf_dir)
    files = _files(copies)
    assert files and all(f.endswith(".gz") for f in files)
    assert len({f.rpartition("/")[0] for f in files}) == bindings.COPIES
    own = staging.native_names(staging.read_external(spark, copies))
    eight = bindings.staging_order(bindings.staging(spark, sf_dir).crossJoin(spark.range(bindings.COPIES)))
    assert sorted(map(repr, rows(own.select(*eight.columns)))) == sorted(map(repr, rows(eight)))


def test_external_files_are_compressed_and_whole(spark, sf_dir):
    files = bindings.external_files(spark, sf_dir)
    assert _files(files) and all(f.endswith(".gz") for f in _files(files))
    own, table = staging.read_csv(spark, files), bindings.staging_order(bindings.staging(spark, sf_dir))
    assert sorted(map(repr, rows(own))) == sorted(map(repr, rows(table)))


def test_a_compressed_file_holds_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(staging.COMPRESSED, "maxRecordsPerFile", 10)
    staging.write_csv(spark.range(0, 35, 1, 1), f"{tmp_path}/c", compressed=True)
    found = spark.read.option("header", True).csv(f"{tmp_path}/c")
    counts = found.groupBy(F.input_file_name()).count()
    assert sorted(r["count"] for r in counts.collect()) == [5, 10, 10, 10]


def test_hundredths_are_those_of_the_decimal(spark):
    more = [1e15 / 3, 9999999999999.99, 0.005, 0.015, 1.115, 4.35, 2.0**53, -0.994999999999999999, 17.994999999999997]
    values = spark.createDataFrame([(x,) for x in [*ODD, *more, *(i / 1000 for i in range(-3000, 3000, 7))]], "x double")
    decimal = F.col("x").cast("decimal(18,2)")
    wrong = values.select("x", money.hundredths(F.col("x"), 18).alias("n"), (decimal * 100).cast("bigint").alias("m"))
    assert rows(wrong.where("not (n <=> m)")) == []
    assert rows(values.where("x = 1.005").select(money.from_units(money.hundredths(F.col("x"), 12), 18, 2).cast("string")).distinct()) == [("1.01",)]
    with pytest.raises(Exception, match="NUMERIC_VALUE_OUT_OF_RANGE|CAST_OVERFLOW"):
        rows(spark.createDataFrame([(1e10,)], "x double").select(money.hundredths(F.col("x"), 12)))


def test_cost_reports_sum_line_items_exactly_without_wide_decimals(spark, sf_dir):
    found = bindings.cost_reports(spark, sf_dir)
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    net = F.sum(price * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")))
    expected = (
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey")
        .agg(F.sum(price).cast("decimal(18,2)").alias("a"), net.cast("decimal(18,4)").alias("b"))
        .join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select("a", (F.col("b") - F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,4)").alias("c"))
    )
    assert sorted(map(repr, rows(found.select("total_charges", "net_income")))) == sorted(map(repr, map(tuple, expected.collect())))
    assert [t for n, t in found.dtypes if n in ("total_expenses", "total_charges", "net_income")] == ["decimal(18,2)", "decimal(18,2)", "decimal(18,4)"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sums = re.findall(r"sum\((\w+)#", plan)
    assert "price" in sums  # BIGINT goes into the sums, not DECIMAL
