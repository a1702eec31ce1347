"""A whole load: CSV files to the staging table, its profile, costs and metrics."""

import datetime
import resource
import time
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardledger.functions.dates import BATCH_STAMP
from wardledger.functions.sizes import MIB, in_unit
from wardledger.operators import benchmark, cost, generate, metrics, profile, quality, yearly
from wardledger.sources import landing, staging


class LoadRun(NamedTuple):
    table: DataFrame
    profile: dict[str, DataFrame]
    results: DataFrame
    path: str


class Client(NamedTuple):
    """Time of a step as its client saw it, and the most memory the client has taken so far."""

    seconds: float
    memory_mb: float


NO_STEP = Client(0.0, 0.0)


def client_since(start: float) -> Client:
    """The step that began at ``start`` of ``time.perf_counter``."""
    return Client(time.perf_counter() - start, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)


def land_sample(
    spark: SparkSession, rows: int, path: str, at: datetime.datetime, seed: int = 42
) -> str:
    """Generate sample reports, check them, and land them as one batch.

    Returns a glob for the files of the batch. A failed check raises.
    """
    sample = generate.synthetic_hospitals(spark, rows, seed)
    failed = [r.check for r in quality.quality_report(sample).collect() if not r.passed]
    if failed:
        raise ValueError(f"sample data failed: {', '.join(failed)}")
    stamp = F.date_format(F.lit(at.isoformat(" ", "seconds")).cast("timestamp_ntz"), BATCH_STAMP)
    name = spark.range(1).select(
        F.concat(F.lit(f"hospital_cost_sample_{rows}rows_"), stamp)
    ).first()[0]
    landing.land(sample.withColumn("batch_name", F.lit(name)), path)
    return f"{path}/batch_name={name}/*.csv"


def load(
    spark: SparkSession, csv_paths: str, table_path: str, engine: str = "Spark", generated: Client = NO_STEP
) -> LoadRun:
    """Load CSV files, and describe the load as one run result.

    The load and one scan for the profile run here; the results are lazy. ``generated`` is what
    the making of the files took, where it was part of the run.
    """
    at = datetime.datetime.now().isoformat(timespec="seconds")
    start = time.perf_counter()
    written = staging.write_measured(
        staging.read_csv(spark, csv_paths), table_path, scanned=profile.PROFILE_COLUMNS
    )
    step = client_since(start)
    table = staging.read_staging(spark, table_path)
    return LoadRun(
        table,
        profile.staging_profile(table),
        run_results(spark, csv_paths, table_path, written, engine, at, step, generated),
        table_path,
    )


def generate_and_load(
    spark: SparkSession, rows: int, landing_path: str, table_path: str, at: datetime.datetime
) -> LoadRun:
    """Make sample reports, land them and load them, with the time of each step."""
    start = time.perf_counter()
    files = land_sample(spark, rows, landing_path, at)
    return load(spark, files, table_path, generated=client_since(start))


def run_results(
    spark: SparkSession,
    csv_paths: str,
    table_path: str,
    written: staging.Load,
    engine: str,
    at: str,
    step: Client,
    generated: Client = NO_STEP,
) -> DataFrame:
    """The result record of a load: what its write counted, file sizes, and costs from these.

    Processed are the bytes that the profile reads, as loads themselves are not charged for;
    slot time is that of all cores for as long as the load took.
    """
    csv_bytes = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    stored = landing.list_files(spark, table_path).agg(csv_bytes.alias("b")).scalar()
    slots = spark.sparkContext.defaultParallelism
    sizes = landing.list_files(spark, csv_paths).agg(csv_bytes.alias("csv_bytes")).select(
        "csv_bytes",
        F.lit(engine).alias("run_id"),
        F.lit(step.seconds).alias("seconds"),
        F.lit(step.memory_mb).alias("memory_mb"),
        F.lit(written.logical_bytes).cast("bigint").alias("logical_bytes"),
        stored.alias("physical_bytes"),
        F.lit(written.scanned_bytes).cast("bigint").alias("processed_bytes"),
        F.lit(int(step.seconds * 1000 * slots)).cast("bigint").alias("slot_ms"),
        F.lit(written.rows).cast("bigint").alias("num_rows"),
        F.lit(written.periods).cast("bigint").alias("num_partitions"),
    )
    return cost.with_costs(sizes).select(
        F.col("run_id").alias("engine"),
        F.lit(at).alias("timestamp"),
        F.lit(generated.seconds).alias("data_generation_seconds"),
        F.lit(generated.memory_mb).alias("data_generation_memory_mb"),
        F.col("seconds").alias("data_load_seconds"),
        F.col("memory_mb").alias("data_load_memory_mb"),
        in_unit(F.col("csv_bytes"), MIB).alias("raw_csv_mb"),
        in_unit(F.col("logical_bytes"), MIB).alias("logical_mb"),
        in_unit(F.col("physical_bytes"), MIB).alias("physical_mb"),
        F.coalesce(F.try_divide("physical_bytes", "logical_bytes"), F.lit(0.0)).alias("compression_ratio"),
        "num_rows",
        "num_partitions",
        "total_usd",
        *[f"{name}_usd" for name in cost.COMPONENTS],
        F.lit(cost.REGION).alias("pricing_region"),
        F.lit(at).alias("pricing_timestamp"),
    ).select(*metrics.RESULT_COLUMNS)


def compare_layouts(
    native: DataFrame,
    external: DataFrame,
    year: int,
    id_range: tuple[int, int],
    iterations: int = 1,
) -> DataFrame:
    """Time the three flagship queries on both layouts; one row per run.

    The result has the columns ``benchmark_summary`` and ``benchmark_overall``
    read. A failing query raises instead of being recorded as unsuccessful.
    """
    queries = {
        "Query_1_Original": {},
        "Query_2_Year_Filtered": {"year": year},
        "Query_3_Multi_Filtered": {"year": year, "id_range": id_range},
    }
    runs = []
    for _ in range(iterations):
        for name, filters in queries.items():
            for side, df in zip(benchmark.SIDES, (native, external)):
                start = time.perf_counter()
                yearly.flagship(df, **filters).write.format("noop").mode("overwrite").save()
                runs.append((name, side, time.perf_counter() - start, True))
    schema = "query_name string, table_type string, t double, success boolean"
    return native.sparkSession.createDataFrame(runs, schema)
