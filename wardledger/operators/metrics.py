"""Run results per engine: the flat record, its long form, its nested form."""

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from wardledger.operators.cost import COMPONENTS
from wardledger.session import fresh_path

LONG_COLUMNS = [
    "engine",
    "timestamp",
    "metric_type",
    "metric_category",
    "metric_name",
    "metric_value",
    "unit",
]

RECENT_JOBS = 5

# One row per engine. ``*_seconds`` and ``*_memory_mb`` are the two recorded
# phases; the sizes describe the staging table; the ``*_usd`` are its costs.
RESULT_COLUMNS = [
    "engine",
    "timestamp",
    "data_generation_seconds",
    "data_generation_memory_mb",
    "data_load_seconds",
    "data_load_memory_mb",
    "raw_csv_mb",
    "logical_mb",
    "physical_mb",
    "compression_ratio",
    "num_rows",
    "num_partitions",
    "total_usd",
    *[f"{name}_usd" for name in COMPONENTS],
    "pricing_region",
    "pricing_timestamp",
]


def _entries(warehouse: str) -> list[tuple[str, str, str, str, str]]:
    """Type, category, name, source column and unit of each row."""
    performance = [
        ("performance", phase, name, f"{phase}_{column}", unit)
        for phase in ("data_generation", "data_load")
        for name, column, unit in (
            ("execution_time_seconds", "seconds", "seconds"),
            ("memory_mb_peak", "memory_mb", "MB"),
        )
    ]
    storage = [
        ("storage", "table_metrics", name, column, unit)
        for name, column, unit in (
            ("CSV", "raw_csv_mb", "MB"),
            (f"{warehouse}_Logical", "logical_mb", "MB"),
            (f"{warehouse}_Physical", "physical_mb", "MB"),
            ("Compression_Ratio", "compression_ratio", "ratio"),
            ("Row_Count", "num_rows", "count"),
            ("Partition_Count", "num_partitions", "count"),
        )
    ]
    cost = [
        ("cost", "cost_breakdown", name, column, "USD")
        for name, column in (
            ("Total_Pipeline_Cost", "total_usd"),
            ("Cloud_Storage_Cost", "cloud_storage_usd"),
            (f"{warehouse}_Processing_Cost", "query_usd"),
            (f"{warehouse}_Storage_Cost", "table_storage_usd"),
            ("Compute_Processing_Cost", "compute_usd"),
            ("Network_Cost", "network_usd"),
        )
    ]
    metadata = [
        ("metadata", "pricing", "pricing_region", "pricing_region", "region"),
        ("metadata", "pricing", "pricing_timestamp", "pricing_timestamp", "timestamp"),
    ]
    return performance + storage + cost + metadata


def long_form(results: DataFrame, warehouse: str = "Warehouse") -> DataFrame:
    """One row per metric; the value is text, as it is a number or a name.

    The groups of metrics are laid side by side in one array per engine, so
    the results are read once.
    """
    rows = [
        F.struct(
            F.lit(kind).alias("metric_type"),
            F.lit(category).alias("metric_category"),
            F.lit(name).alias("metric_name"),
            F.col(column).cast("string").alias("metric_value"),
            F.lit(unit).alias("unit"),
        )
        for kind, category, name, column, unit in _entries(warehouse)
    ]
    return results.select("engine", "timestamp", F.inline(F.array(*rows))).select(*LONG_COLUMNS)


def recent_jobs(jobs: DataFrame, k: int = RECENT_JOBS) -> DataFrame:
    """The ``k`` newest jobs of each engine as one array.

    The row limit is applied inside each task before rows move, so an engine
    with any number of jobs sends ``k`` rows per task.
    """
    newest = Window.partitionBy("engine").orderBy(F.desc("creation_time"), F.desc("job_id"))
    kept = jobs.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)
    job = F.struct("place", "job_id", "total_slot_ms", "total_bytes_processed", "total_bytes_billed")
    return kept.groupBy("engine").agg(F.sort_array(F.collect_list(job)).alias("jobs"))


def _phase(name: str) -> Column:
    return F.struct(
        F.col(f"{name}_seconds").alias("execution_time_seconds"),
        F.col(f"{name}_memory_mb").alias("memory_mb_peak"),
    ).alias(name)


def nested_form(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """One nested record per engine, with its newest jobs."""
    storage = ["raw_csv_mb", "logical_mb", "physical_mb", "compression_ratio", "num_rows",
               "num_partitions"]
    breakdown = F.struct(*[F.col(f"{name}_usd") for name in COMPONENTS])
    return results.join(recent_jobs(jobs), "engine", "left").select(
        F.col("engine").alias("engine_name"),
        F.col("timestamp").alias("test_timestamp"),
        _phase("data_generation"),
        _phase("data_load"),
        F.struct(*storage).alias("storage_metrics"),
        F.col("jobs"),
        F.struct(
            F.col("total_usd"),
            breakdown.alias("cost_breakdown"),
            "pricing_region",
            "pricing_timestamp",
        ).alias("cost_metrics"),
    )


def flat_form(nested: DataFrame) -> DataFrame:
    """The flat record back from its nested form."""
    return nested.select(
        F.col("engine_name").alias("engine"),
        F.col("test_timestamp").alias("timestamp"),
        *[
            F.col(f"{phase}.{field}").alias(f"{phase}_{name}")
            for phase in ("data_generation", "data_load")
            for field, name in (("execution_time_seconds", "seconds"), ("memory_mb_peak", "memory_mb"))
        ],
        "storage_metrics.*",
        "cost_metrics.total_usd",
        *[f"cost_metrics.cost_breakdown.{name}_usd" for name in COMPONENTS],
        "cost_metrics.pricing_region",
        "cost_metrics.pricing_timestamp",
    )


def write_long_form(long: DataFrame, path: str) -> None:
    long.write.option("header", True).csv(path)


def read_long_form(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(name, T.StringType()) for name in LONG_COLUMNS])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def csv_roundtrip(long: DataFrame) -> DataFrame:
    """Write the long form as CSV and read it back."""
    spark = long.sparkSession
    path = fresh_path(spark, "metrics-csv")
    write_long_form(long, path)
    return read_long_form(spark, path)


def write_json(nested: DataFrame, path: str) -> None:
    nested.write.json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_roundtrip(nested: DataFrame) -> DataFrame:
    """Write the nested records as JSON and read them back."""
    spark = nested.sparkSession
    path = fresh_path(spark, "metrics-json")
    write_json(nested, path)
    return read_json(spark, path, nested.schema)
