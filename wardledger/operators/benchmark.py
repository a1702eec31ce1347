"""Comparison tables over recorded runs, phases, jobs and stored objects."""

from pyspark.sql import Column, DataFrame, functions as F

from wardledger.functions.money import percent_change, ratio_or_zero
from wardledger.functions.sizes import MIB, in_unit
from wardledger.operators.cost import on_demand_usd

SIDES = ["native", "external"]
PHASES = ["data_generation", "data_load", "analytics"]
SLOW_PERCENT = 10


def _mean_where(value: str, kept: Column) -> Column:
    chosen = F.when(kept, F.col(value))
    return F.try_divide(F.sum(chosen).cast("double"), F.count(chosen))


def _side_means(runs: DataFrame) -> list[Column]:
    return [_mean_where("t", F.col("table_type") == side).alias(side) for side in SIDES]


def status(difference: Column) -> Column:
    return (
        F.when(difference > SLOW_PERCENT, "red").when(difference > 0, "amber").otherwise("green")
    )


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Native against external mean time of each query, successful runs only.

    Both sides come from one aggregation; a query without a successful run on
    both sides drops out, as in an inner join on the query name.
    """
    means = (
        runs.filter("success")
        .groupBy("query_name")
        .agg(*_side_means(runs))
        .filter(F.col("native").isNotNull() & F.col("external").isNotNull())
    )
    change = F.round(percent_change(F.col("external"), F.col("native")), 1)
    return means.select(
        "query_name",
        F.round("native", 3).alias("native_avg_time"),
        F.round("external", 3).alias("external_avg_time"),
        change.alias("performance_difference_pct"),
        (F.col("external") > F.col("native")).alias("external_slower"),
        status(change).alias("status"),
    )


def benchmark_overall(runs: DataFrame) -> DataFrame:
    """Mean time of each side over all queries, and successful runs."""
    counts = [
        F.count_if(F.col("success") & (F.col("table_type") == side)).alias(f"{side}_ok")
        for side in SIDES
    ]
    means = runs.agg(
        *[
            _mean_where("t", F.col("success") & (F.col("table_type") == side)).alias(
                f"{side}_avg"
            )
            for side in SIDES
        ],
        *counts,
    )
    change = percent_change(F.col("external_avg"), F.col("native_avg"))
    return means.select(
        "native_avg",
        "external_avg",
        F.round(change, 1).alias("overall_diff_pct"),
        "native_ok",
        "external_ok",
    )


def engine_comparison(phases: DataFrame) -> DataFrame:
    """Seconds of the usual phases, of all others together, and in total, per engine."""
    phase, seconds = F.col("phase"), F.col("seconds")
    usual = F.coalesce(phase.isin(PHASES), F.lit(False))

    def total(rows: Column) -> Column:
        return F.coalesce(F.sum(F.when(rows, seconds)), F.lit(0)).cast("double")

    return phases.groupBy("engine").agg(
        *[total(phase == p).alias(p) for p in PHASES],
        total(~usual).alias("other"),
        total(F.lit(True)).alias("total"),
    )


def phase_rollup(phases: DataFrame) -> DataFrame:
    """Time of all phases and the highest memory use, per engine."""
    return phases.groupBy("engine").agg(
        F.sum("seconds").cast("double").alias("total_seconds"),
        F.max("memory_mb").cast("bigint").alias("peak_memory"),
    )


def resource_samples_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("phase").agg(
        F.avg("cpu_percent").alias("cpu_avg"),
        F.max("cpu_percent").cast("bigint").alias("cpu_max"),
        F.avg("memory_mb").alias("mem_avg"),
        F.max("memory_mb").cast("bigint").alias("mem_max"),
    )


def engine_cost_comparison(jobs: DataFrame) -> DataFrame:
    """Billed query cost per engine, from the exact sum of billed bytes."""
    billed = F.sum(F.col("total_bytes_billed").cast("decimal(20,0)"))
    return jobs.groupBy("engine").agg(on_demand_usd(billed).alias("cost"))


def storage_ratio(objects: DataFrame) -> DataFrame:
    """Logical and physical size; the ratio is 0 for an empty table."""
    logical, physical = F.col("size_bytes"), F.col("physical_bytes")
    return objects.select(
        "object_id",
        in_unit(logical, MIB).alias("logical_mb"),
        in_unit(physical, MIB).alias("physical_mb"),
        ratio_or_zero(physical, logical).alias("ratio"),
    )
