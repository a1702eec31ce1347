import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.operators import benchmark, metrics

RUN = "query_name string, table_type string, t decimal(12,2), success boolean"


def runs(spark, items):
    return spark.createDataFrame([(q, s, Decimal(t), ok) for q, s, t, ok in items], RUN)


def test_summary_keeps_queries_with_both_sides(spark):
    df = runs(
        spark,
        [
            ("a", "native", "2.00", True), ("a", "native", "4.00", True), ("a", "native", "9.00", False),
            ("a", "external", "3.60", True),
            ("b", "native", "1.00", True), ("b", "external", "9.00", False),
            ("c", "native", "2.00", True), ("c", "external", "2.10", True),
            ("d", "native", "2.00", True), ("d", "external", "2.00", True),
        ],
    )
    assert sorted(rows(benchmark.benchmark_summary(df))) == [
        ("a", 3.0, 3.6, 20.0, True, "red"),
        ("c", 2.0, 2.1, 5.0, True, "amber"),
        ("d", 2.0, 2.0, 0.0, False, "green"),
    ]


def test_overall(spark):
    df = runs(spark, [("a", "native", "2.00", True), ("b", "native", "4.00", True),
                      ("a", "external", "1.50", True), ("b", "external", "7.00", False)])
    assert rows(benchmark.benchmark_overall(df)) == [(3.0, 1.5, -50.0, 2, 1)]
    assert rows(benchmark.benchmark_overall(df.limit(0))) == [(None, None, None, 0, 0)]


def test_phases(spark):
    df = spark.createDataFrame(
        [("native", "data_load", Decimal("1.25"), 10, 100), ("native", "analytics", Decimal("2.00"), 30, 150),
         ("spark", "data_load", Decimal("4.00"), 20, 120)],
        "engine string, phase string, seconds decimal(12,2), cpu_percent int, memory_mb int",
    )
    assert sorted(rows(benchmark.engine_comparison(df))) == [
        ("native", 0.0, 1.25, 2.0, 0.0, 3.25), ("spark", 0.0, 4.0, 0.0, 0.0, 4.0),
    ]
    assert sorted(rows(benchmark.phase_rollup(df))) == [("native", 3.25, 150), ("spark", 4.0, 120)]
    assert sorted(rows(benchmark.resource_samples_summary(df))) == [
        ("analytics", 30.0, 30, 150.0, 150), ("data_load", 15.0, 20, 110.0, 120),
    ]


def test_phases_of_any_name_count(spark):
    df = spark.createDataFrame(
        [("spark", "upload", 2.0), ("spark", "data_load", 0.8), ("spark", None, 0.4)], "engine string, phase string, seconds double"
    )
    row = benchmark.engine_comparison(df).first()
    assert (row.data_load, row.other, row.total) == (0.8, 2.4, pytest.approx(3.2))


def test_storage_ratio_of_an_empty_table_is_zero(spark):
    df = spark.createDataFrame(
        [(1, 12363, 26447), (2, 0, 5)], "object_id long, size_bytes long, physical_bytes long"
    )
    found = {r.object_id: r for r in benchmark.storage_ratio(df).collect()}
    assert round(found[1].ratio, 2) == 2.14
    assert found[2].ratio == 0.0


def test_engine_costs(spark):
    df = spark.createDataFrame(
        [("native", 1024**4), ("native", 1024**4), ("spark", None)],
        "engine string, total_bytes_billed long",
    )
    assert sorted(rows(benchmark.engine_cost_comparison(df))) == [("native", 10.0), ("spark", 0.0)]


def results(spark):
    values = {name: F.lit(float(i)) for i, name in enumerate(metrics.RESULT_COLUMNS)}
    texts = {"engine": "Spark", "timestamp": "t0", "pricing_region": "us-central1", "pricing_timestamp": "t1"}
    values |= {name: F.lit(text) for name, text in texts.items()}
    values |= {"num_rows": F.lit(100), "num_partitions": F.lit(4)}
    return spark.range(1).select(*[v.alias(n) for n, v in values.items()])


def jobs(spark, n=9):
    return spark.range(n).select(
        F.lit("Spark").alias("engine"),
        F.col("id").alias("job_id"),
        (F.col("id") % 4).alias("creation_time"),
        F.lit(1).alias("total_slot_ms"),
        F.lit(2).alias("total_bytes_processed"),
        F.lit(3).alias("total_bytes_billed"),
    )


def test_long_form(spark):
    df = metrics.long_form(results(spark))
    assert df.columns == metrics.LONG_COLUMNS
    found = {(r.metric_type, r.metric_category, r.metric_name): r for r in df.collect()}
    assert len(found) == 18
    assert found["storage", "table_metrics", "Row_Count"].metric_value == "100"
    assert found["metadata", "pricing", "pricing_region"].metric_value == "us-central1"
    assert found["performance", "data_load", "memory_mb_peak"].unit == "MB"
    other = {r.metric_name for r in metrics.long_form(results(spark), "Lake").collect()}
    assert {"Lake_Logical", "Lake_Physical", "Lake_Processing_Cost", "Lake_Storage_Cost"} <= other


def test_json_roundtrip_keeps_every_value(spark):
    nested = metrics.nested_form(results(spark), jobs(spark))
    back = metrics.json_roundtrip(nested)
    assert metrics.flat_form(back).select(*metrics.RESULT_COLUMNS).first() == results(spark).first()
    assert [j.job_id for j in back.first().jobs] == [7, 3, 6, 2, 5]


def test_recent_jobs_are_limited_before_the_shuffle(spark):
    engines = F.concat(F.lit("engine"), (F.col("job_id") % 3).cast("string"))
    recent = metrics.recent_jobs(jobs(spark, 1000).withColumn("engine", engines))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert [len(r.jobs) for r in recent.collect()] == [5, 5, 5]


def test_engine_without_jobs_keeps_its_record(spark):
    nested = metrics.nested_form(results(spark), jobs(spark, 0))
    assert nested.first().jobs is None
