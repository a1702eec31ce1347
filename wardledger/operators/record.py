"""The whole result record of an engine: performance, storage, jobs and costs, unrounded.

One nested row for each engine, built from four tables that meet in outer joins of one row an
engine: an engine without stored objects, jobs or samples keeps its record, with NULL
performance, zero sizes and no jobs. The record goes to JSON and back without loss: doubles are
written in the shortest form that reads back as the same bits.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardledger.functions.sizes import GIB, MIB, TIB, in_unit
from wardledger.functions.sums import mean, summarise, total
from wardledger.operators import cost

PHASES = ("data_generation", "data_load")
RECENT_JOBS = 5
#: The fields of a job in the record, in order.
JOB_FIELDS = [
    "job_id",
    "job_type",
    "state",
    "creation_time",
    "start_time",
    "end_time",
    "total_slot_ms",
    "total_bytes_processed",
    "total_bytes_billed",
    "query_cost_usd",
    "num_dml_affected_rows",
]
DAYS_STORED = 30
MACHINE = "e2-micro"


def _iso(time: Column) -> Column:
    """A timestamp as text; an absent one is empty."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def performance(samples: DataFrame) -> DataFrame:
    """engine and a struct for each phase, from samples (engine, phase, seconds, cpu_percent, memory_mb, at)."""
    known = samples.filter(F.col("phase").isin(*PHASES)).withColumns(
        {"cpu_percent": F.col("cpu_percent").cast("double"), "memory_mb": F.col("memory_mb").cast("double")}
    )
    sums = summarise(
        known,
        {"engine": F.col("engine"), "phase": F.col("phase")},
        {"seconds": total("seconds"), "cpu": mean("cpu_percent"), "memory": mean("memory_mb")},
    )
    ends = known.groupBy("engine", "phase").agg(
        F.max("cpu_percent").alias("cpu_max"),
        F.max("memory_mb").alias("memory_max"),
        F.min("at").alias("first"),
        F.max("at").alias("last"),
    )
    fields = F.struct(
        F.col("seconds").alias("execution_time_seconds"),
        F.col("cpu").alias("cpu_percent_avg"),
        F.col("cpu_max").alias("cpu_percent_max"),
        F.col("memory").alias("memory_mb_avg"),
        F.col("memory_max").alias("memory_mb_max"),
        F.col("memory_max").alias("memory_mb_peak"),
        _iso(F.col("first")).alias("start_time"),
        _iso(F.col("last")).alias("end_time"),
    )
    both = sums.join(ends, ["engine", "phase"]).select("engine", "phase", fields.alias("p"))
    return both.groupBy("engine").agg(*[F.max(F.when(F.col("phase") == name, F.col("p"))).alias(name) for name in PHASES])


def storage(objects: DataFrame) -> DataFrame:
    """engine and its sizes, from objects (engine, size_bytes, physical_bytes, partition)."""
    return objects.groupBy("engine").agg(
        cost.whole_sum(F.col("size_bytes")).alias("raw_csv_bytes"),
        cost.whole_sum(F.col("size_bytes")).alias("logical_bytes"),
        cost.whole_sum(F.col("physical_bytes")).alias("physical_bytes"),
        F.count("*").alias("num_rows"),
        F.count_distinct("partition").alias("num_partitions"),
    )


def jobs(history: DataFrame, k: int = RECENT_JOBS) -> DataFrame:
    """engine, its byte and slot totals over all jobs, and its ``k`` newest jobs.

    The row limit is applied inside each task before rows move.
    """
    zero = lambda name: F.coalesce(F.col(name), F.lit(0).cast("bigint"))
    priced = history.select(
        "engine",
        F.col("creation_time").alias("created"),
        "job_id",
        "job_type",
        "state",
        _iso(F.col("creation_time")).alias("creation_time"),
        _iso(F.col("start_time")).alias("start_time"),
        _iso(F.col("end_time")).alias("end_time"),
        *[zero(n).alias(n) for n in ("total_slot_ms", "total_bytes_processed", "total_bytes_billed", "num_dml_affected_rows")],
    ).withColumn("query_cost_usd", cost.on_demand_usd(F.col("total_bytes_billed")))
    newest = Window.partitionBy("engine").orderBy(F.desc("created"), F.desc("job_id"))
    kept = priced.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= k)
    lists = kept.groupBy("engine").agg(
        F.sort_array(F.collect_list(F.struct("place", *JOB_FIELDS))).alias("jobs")
    )
    totals = priced.groupBy("engine").agg(
        cost.whole_sum(F.col("total_bytes_processed")).alias("bytes_processed"), cost.whole_sum(F.col("total_slot_ms")).alias("slot_milliseconds")
    )
    return totals.join(lists, "engine")


def service_details(runs: DataFrame) -> DataFrame:
    """Add a struct of all figures for each priced service.

    ``runs`` has ``seconds, memory_mb, raw_csv_bytes, logical_bytes, physical_bytes,
    bytes_processed, slot_milliseconds``.
    """
    days, machine = F.lit(DAYS_STORED), F.lit(MACHINE)
    rate = F.lit(cost._USD["object_storage", cost.DEFAULT_STORAGE_CLASS])
    stored = cost.object_usd(F.col("raw_csv_bytes"), rate, days)
    on_demand, slot = cost.on_demand_usd(F.col("bytes_processed")), cost.slot_usd(F.col("slot_milliseconds"))
    active, longterm = cost.active_usd(F.col("logical_bytes"), days), cost.longterm_usd(F.col("physical_bytes"), days)
    hours = F.col("seconds") / F.lit(3600.0)
    memory_hours = F.col("memory_mb") / F.lit(1024.0) * hours
    base = cost.compute_base_usd(machine, hours, memory_hours)
    discount = cost.compute_discount_usd(machine, hours, base)
    egress = in_unit(F.col("raw_csv_bytes"), GIB)
    services = {
        "cloud_storage": {
            "total_storage_cost_usd": stored + cost.upload_usd(),
            "storage_cost_usd": stored,
            "operations_cost_usd": cost.upload_usd(),
            "size_gb": egress,
            "storage_class": F.lit(cost.DEFAULT_STORAGE_CLASS),
            "rate_per_gb_month": rate,
        },
        "query": {
            "on_demand_cost_usd": on_demand,
            "slot_cost_usd": slot,
            "recommended_cost_usd": cost.cheaper_usd(on_demand, slot),
            "bytes_processed": F.col("bytes_processed"),
            "tb_processed": in_unit(F.col("bytes_processed"), TIB),
            "slot_milliseconds": F.col("slot_milliseconds"),
        },
        "table_storage": {
            "total_storage_cost_usd": active + longterm,
            "active_storage_cost_usd": active,
            "longterm_storage_cost_usd": longterm,
            "logical_gb": in_unit(F.col("logical_bytes"), GIB),
            "physical_gb": in_unit(F.col("physical_bytes"), GIB),
            "days_stored": days,
        },
        "compute": {
            "total_compute_cost_usd": cost.after_discount(base, discount),
            "base_cost_usd": base,
            "free_tier_discount_usd": discount,
            "vcpu_hours": hours,
            "memory_gb_hours": memory_hours,
            "machine_type": machine,
        },
        "network": {
            "total_network_cost_usd": cost.network_usd(egress) + F.lit(0.0),
            "egress_cost_usd": cost.network_usd(egress),
            "ingress_cost_usd": F.lit(0.0),
            "egress_gb": egress,
            "billable_egress_gb": cost.billable_gb(egress),
            "free_egress_used_gb": F.least(egress, F.lit(cost.FREE_EGRESS_GB)),
        },
    }
    return runs.withColumns(
        {f"{name}_detail": F.struct(*[v.alias(k) for k, v in fields.items()]) for name, fields in services.items()}
    )


#: Which figure of a service is its part of the cost.
PARTS = {
    "cloud_storage": "total_storage_cost_usd",
    "query": "recommended_cost_usd",
    "table_storage": "total_storage_cost_usd",
    "compute": "total_compute_cost_usd",
    "network": "total_network_cost_usd",
}


def record(samples: DataFrame, objects: DataFrame, history: DataFrame, at: str, region: str = cost.REGION) -> DataFrame:
    """The nested record of every engine that any of the three tables names."""
    joined = (
        performance(samples).join(storage(objects), "engine", "full").join(jobs(history), "engine", "full")
    )
    zero = lambda column: F.coalesce(column, F.lit(0).cast("bigint"))
    counts = ("raw_csv_bytes", "logical_bytes", "physical_bytes", "num_rows", "num_partitions", "bytes_processed", "slot_milliseconds")
    seconds = [F.coalesce(F.col(f"{p}.execution_time_seconds"), F.lit(0.0)) for p in PHASES]
    peaks = [F.coalesce(F.col(f"{p}.memory_mb_peak"), F.lit(0.0)) for p in PHASES]
    priced = service_details(
        joined.withColumns({c: zero(F.col(c)) for c in counts}).withColumns(
            {"seconds": seconds[0] + seconds[1], "memory_mb": F.greatest(*peaks)}
        )
    )
    parts = {name: F.col(f"{name}_detail.{field}") for name, field in PARTS.items()}
    whole = parts["cloud_storage"] + parts["query"] + parts["table_storage"] + parts["compute"] + parts["network"]
    return priced.select(
        F.col("engine").alias("engine_name"),
        F.lit(at).alias("test_timestamp"),
        *PHASES,
        F.struct(
            "raw_csv_bytes",
            in_unit(F.col("raw_csv_bytes"), MIB).alias("raw_csv_mb"),
            "logical_bytes",
            "physical_bytes",
            in_unit(F.col("logical_bytes"), MIB).alias("logical_mb"),
            in_unit(F.col("physical_bytes"), MIB).alias("physical_mb"),
            F.coalesce(F.try_divide(F.col("physical_bytes").cast("double"), F.col("logical_bytes").cast("double")), F.lit(0.0)).alias("compression_ratio"),
            "num_rows",
            "num_partitions",
        ).alias("storage_metrics"),
        F.coalesce("jobs", F.array().cast(joined.schema["jobs"].dataType)).alias("jobs"),
        F.struct(
            whole.alias("total_cost_usd"),
            *[part.alias(f"{name}_cost_usd") for name, part in parts.items()],
            F.struct(*[F.col(f"{name}_detail").alias(name) for name in PARTS]).alias("cost_breakdown"),
            F.lit(region).alias("pricing_region"),
            F.lit(at).alias("pricing_timestamp"),
        ).alias("cost_metrics"),
        whole.alias("total_cost_usd"),
    )


def performance_rows(records: DataFrame) -> DataFrame:
    """One row for each engine and phase that was measured."""
    phases = F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("p")) for p in PHASES])
    return records.select("engine_name", F.inline(phases)).filter("p IS NOT NULL").select("engine_name", "phase", "p.*")


def storage_rows(records: DataFrame) -> DataFrame:
    return records.select("engine_name", "storage_metrics.*")


def job_rows(records: DataFrame) -> DataFrame:
    return records.select("engine_name", F.inline("jobs"))


def cost_rows(records: DataFrame) -> DataFrame:
    """One wide row for each engine; figures of a service carry its name."""
    detail = records.schema["cost_metrics"].dataType["cost_breakdown"].dataType
    figures = [
        F.col(f"cost_metrics.cost_breakdown.{service.name}.{figure.name}").alias(f"detail_{service.name}_{figure.name}")
        for service in detail
        for figure in service.dataType
    ]
    own = [f"cost_metrics.{n}" for n in ("total_cost_usd", *[f"{p}_cost_usd" for p in PARTS], "pricing_region")]
    return records.select("engine_name", *own, *figures)
