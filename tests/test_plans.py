"""The physical plans keep the properties the workload was laid out for."""

import contextlib
import datetime
import io
import re

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.functions import dates, money, sizes, text
from wardledger.operators import cost, profile, yearly
from wardledger.session import fresh_path, shared_root
from wardledger.sources import staging


@pytest.fixture
def stored(spark, reports):
    path = fresh_path(spark, "plans")
    items = [(p, 2020 + p % 4, 40 + p % 50, 10.0, float(p)) for p in range(400)]
    staging.write_staging(reports(items), path)
    return staging.read_staging(spark, path)


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_year_filter_prunes_partitions(stored):
    text_ = plan(yearly.flagship(stored, year=2022))
    filters = re.search(r"PartitionFilters: \[(.*)\]", text_).group(1)
    assert "2022-01-01" in filters and "2023-01-01" in filters


def test_filters_and_columns_reach_the_scan(stored):
    text_ = plan(yearly.flagship(stored, id_range=(100, 120)))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text_).group(1)
    assert "GreaterThan(beds_number,50)" in pushed
    assert "GreaterThanOrEqual(provider_id,100)" in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", text_).group(1)
    assert "hospital_name" not in schema and "patient_days" not in schema


def test_year_filter_reaches_a_csv_scan(spark, reports):
    path = fresh_path(spark, "csv-plan")
    staging.write_csv(reports([(1, 2023, 60, 1.0, 1.0)]), path)
    external = staging.native_names(staging.read_external(spark, path))
    text_ = plan(yearly.flagship(external, year=2023))
    assert "GreaterThanOrEqual(reporting_period_end,2023-01-01)" in text_
    assert rows(yearly.flagship(external, year=2023).select("provider_id")) == [(1,)]


def test_limited_flagship_never_shuffles_by_year(stored):
    text_ = plan(yearly.flagship(stored))
    keys = re.findall(r"hashpartitioning\((.*?), \d+\)", text_)
    assert keys and all("provider_id" in k for k in keys)
    assert "TakeOrderedAndProject" in text_


def test_top_lists_are_not_fully_sorted(stored):
    assert "TakeOrderedAndProject" in plan(profile.by_state(stored))
    assert "TakeOrderedAndProject" in plan(profile.top_expense_hospitals(stored))


def test_partition_counts_read_no_data_column(stored):
    counts = staging.partition_counts({"a": stored, "b": stored})
    text_ = plan(counts.filter(F.col("table_name") == "a"))
    assert len(re.findall(r"^\(\d+\) Scan parquet", text_, re.M)) == 1
    assert "ReadSchema: struct<>" in text_


def test_rate_lookup_is_a_broadcast_of_literals(spark):
    objects = spark.range(5).selectExpr(
        "id AS object_id", "id AS size_bytes", "id AS days_stored",
        "concat('class', id) AS storage_class")
    text_ = plan(cost.storage_cost(objects))
    assert "BroadcastHashJoin" in text_ and "LocalTableScan" in text_


def test_no_python_in_the_plans(stored):
    for df in (yearly.flagship(stored), profile.by_year(stored), profile.state_analysis(stored)):
        assert "Python" not in plan(df)


def test_year_equals_is_a_half_open_range(spark):
    days = [datetime.date(2022, 12, 31), datetime.date(2023, 1, 1), datetime.date(2023, 12, 31),
            datetime.date(2024, 1, 1), None]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert rows(df.filter(dates.year_equals(F.col("d"), 2023))) == [(days[1],), (days[2],)]


def test_scalar_functions(spark):
    one = spark.range(1)
    at = F.lit(datetime.datetime(2025, 9, 9, 9, 26, 37)).cast("timestamp_ntz")
    assert one.select(dates.batch_name(F.lit(100), at)).first()[0] == (
        "hospital_cost_sample_100rows_20250909_092637"
    )
    assert str(one.select(dates.year_end(at)).first()[0]) == "2025-12-31"
    assert one.select(text.dollars(F.lit(1234567.4))).first()[0] == "$1,234,567"
    assert one.select(text.whole(F.lit(2.5))).first()[0] == "2"
    assert one.select(text.display_name(F.lit("Austin"), F.lit("General"))).first()[0] == "Austin General"
    sizes_ = [sizes.clamp(F.lit(v), 25, 1200) for v in (1, 30, 5000)]
    assert tuple(one.select(*sizes_).first()) == (25, 30, 1200)
    assert one.select(sizes.in_unit(F.lit(1024**3), sizes.GIB)).first()[0] == 1.0
    counts = [text.json_rows(F.lit(v)) for v in ('[{"a":1},{"a":2}]', "[]", None)]
    assert tuple(one.select(*counts).first()) == (2, 0, 0)
    ratios = [money.ratio(F.lit(1), F.lit(0)), money.ratio_or_zero(F.lit(1), F.lit(0)),
              money.percent_change(F.lit(3.0), F.lit(2.0))]
    assert tuple(one.select(*ratios).first()) == (None, 0.0, 50.0)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
