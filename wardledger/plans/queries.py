"""Every query of the engine by name, over the tables of a data folder."""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardledger.functions import dates, sizes, text
from wardledger.operators import (
    benchmark,
    cost,
    generate,
    metrics,
    profile,
    quality,
    ranking,
    record,
    yearly,
)
from wardledger.plans import bindings
from wardledger.session import fresh_path, materialise
from wardledger.sources import landing, scans, staging, versions

YEAR = 1997
ID_RANGE = (100020, 100040)
MIN_EXPENSES = 100_000
PROJECTION_FACTORS = [1, 10, 100, 1_000, 10_000]

Query = Callable[[SparkSession, str], DataFrame]


def _on(source: Callable[[SparkSession, str], DataFrame], operator) -> Query:
    return lambda spark, sf_dir: operator(source(spark, sf_dir))


def _stg(operator) -> Query:
    return _on(bindings.staging, operator)


def _external(operator) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = staging.read_external(spark, bindings.external_files(spark, sf_dir))
        return operator(staging.native_names(files))

    return run


def _unused_name(label: str) -> str:
    """A table name no catalog holds: the checks must not replace real tables."""
    return f"wardledger_{label}_{uuid.uuid4().hex}"


# Flagship workload

def _analytics(operator) -> Query:
    return _on(bindings.analytics, operator)


def _flagship_by_value(stg: DataFrame) -> DataFrame:
    """The full report without its provider-years being written first."""
    summary = yearly.with_neighbour_years(yearly.yearly_summary(yearly.cost_reports(stg)))
    ranked = ranking.rank_incomes_by_value(summary)
    return ranked.select(*yearly.FLAGSHIP_COLUMNS)


def _analytics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "analytics-table")
    ranked = yearly.flagship(bindings.staging(spark, sf_dir), limit=None)
    return staging.recreate_table(ranked, _unused_name("analytics"), path, [])


def _analytics_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = bindings.analytics(spark, sf_dir)
    return ranked.orderBy("report_year", "income_rank", "provider_id").limit(10)


def _cast_date_year(stg: DataFrame) -> DataFrame:
    as_text = stg.withColumn("report_period", F.col("report_period").cast("string"))
    return yearly.yearly_summary(
        yearly.cost_reports(
            as_text.withColumn("report_period", F.to_date("report_period")), min_beds=50
        )
    )


# Loads and read-backs

def _all_columns(df: DataFrame) -> DataFrame:
    return df.select(*bindings.STAGED_COLUMNS, *bindings.DAY_COUNTS)


def _csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    staging.write_csv(bindings.staging_order(bindings.staging(spark, sf_dir)), path)
    return _all_columns(staging.read_csv(spark, path))


def _load(modes: list[str]) -> Query:
    """Load the cost reports into one new table, once per mode."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fresh_path(spark, "load")
        reports = bindings.staging_order(bindings.staging(spark, sf_dir))
        for mode in modes:
            staging.write_staging(reports, path, mode)
        return _all_columns(staging.read_staging(spark, path))

    return run


def _csv_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bindings.external_files(spark, sf_dir)
    return _all_columns(staging.load_staging(spark, files, fresh_path(spark, "csv-load")))


def _versioned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch a report period, appended to a versioned table; the first of them comes twice."""
    path = fresh_path(spark, "versioned")
    reports = bindings.staging_order(bindings.staging(spark, sf_dir))
    periods = [r[0] for r in reports.select("report_period").distinct().orderBy("report_period").collect()]
    for period in [*periods[:1], *periods]:
        staging.load_batch(reports.filter(F.col("report_period") == period), path, f"reports-{period}")
    return _all_columns(versions.read(spark, path))


def _table_recreate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create the catalog table from large hospitals only, then from all."""
    reports = bindings.staging_order(bindings.staging(spark, sf_dir))
    name = _unused_name("staging")
    for part in (reports.filter(F.col("beds_number") > 50), reports):
        table = staging.recreate_table(
            staging.clustered(part),
            name,
            fresh_path(spark, "recreated"),
            ["report_period"],
        )
    return _all_columns(table)


def _external_names(df: DataFrame) -> DataFrame:
    names = {"beds_number": "beds", "report_period": "reporting_period_end"}
    return df.select(*[names.get(c, c) for c in (*bindings.STAGED_COLUMNS, *bindings.DAY_COUNTS)])


def _external_renamed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bindings.external_files(spark, sf_dir)
    return _external_names(staging.read_external(spark, files))


def _external_multi_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bindings.external_copies(spark, sf_dir)
    return _external_names(staging.read_external(spark, files))


def _external_copies_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = staging.read_external(spark, bindings.external_copies(spark, sf_dir))
    return yearly.yearly_summary(yearly.cost_reports(staging.native_names(copies)))


def _latest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.latest_batch(spark, bindings.landing(spark, sf_dir))


def _partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    external = staging.read_external(spark, bindings.external_files(spark, sf_dir))
    tables = {
        "stg_hospital_costs": bindings.staging(spark, sf_dir),
        "ext_hospital_costs": staging.native_names(external),
    }
    counts = staging.partition_counts(tables)
    return counts.filter(F.col("table_name") == "stg_hospital_costs").drop("table_name")


def _storage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the staging table by report period, next to the rows they hold."""
    files = landing.storage_metrics(spark, bindings.staging_path(spark, sf_dir))
    period = F.to_date(F.regexp_extract("file_path", r"report_period=([0-9-]+)", 1))
    sizes = files.groupBy(period.alias("report_period")).agg(
        F.bool_and(F.col("size_bytes") > 0).alias("all_sized"),
        (F.count("*") == F.count_distinct("file_path")).alias("paths_distinct"),
    )
    rows = bindings.staging(spark, sf_dir).groupBy("report_period").agg(F.count("*").alias("rows"))
    return sizes.join(rows, "report_period", "full").select("report_period", "rows", "all_sized", "paths_distinct")


def _yearly_summary_sample(stg: DataFrame) -> DataFrame:
    """How many rows an unordered sample has, and how many of them are rows of the summary."""
    summary = materialise(yearly.yearly_summary(yearly.cost_reports(stg)), "summary")
    sample = summary.limit(10).withColumn("sampled", F.lit(1))
    found = sample.join(summary.select(*summary.columns), summary.columns, "left_semi")
    return sample.agg(F.count("*").alias("rows")).select("rows", found.agg(F.count("*")).scalar().alias("rows_in_summary"))


def _scan_reduction(stg: DataFrame) -> DataFrame:
    return profile.scan_reduction(stg, dates.year_equals(F.col("report_period"), YEAR))


def _table_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staging table as a whole; its files are compared by what is fixed about them."""
    found = landing.table_storage(spark, bindings.staging_path(spark, sf_dir), bindings.staging(spark, sf_dir))
    ratio = F.col("physical_bytes") / F.col("logical_bytes")
    return found.select(
        "num_rows", "num_partitions", "logical_bytes", "logical_mb",
        (F.col("files") >= F.col("num_partitions")).alias("files_in_each_partition"),
        (F.col("physical_bytes") > 0).alias("sized"),
        (F.col("compression_ratio") == ratio).alias("ratio_of_both"),
    )


def _load_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load counts while it writes the cost reports from their files."""
    files = staging.read_csv(spark, bindings.external_files(spark, sf_dir))
    load = staging.write_measured(files, fresh_path(spark, "measured"), scanned=profile.PROFILE_COLUMNS)
    values = {
        "rows": load.rows,
        "periods": load.periods,
        "logical_bytes": load.logical_bytes,
        "scanned_bytes": load.scanned_bytes,
        "null_values": sum(load.null_values.values()),
    }
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in values.items()])


def _scan_reduction_measured(stg: DataFrame) -> DataFrame:
    """What a year's filter saves; files and bytes are compared by what is fixed about them."""
    found = scans.scan_reduction(stg, dates.year_equals(F.col("report_period"), YEAR))
    return found.select(
        "total_rows", "kept_rows", "total_rows_read", "kept_rows_read", "total_partitions", "kept_partitions",
        (F.col("kept_files") < F.col("total_files")).alias("fewer_files"),
        (F.col("kept_bytes") < F.col("total_bytes")).alias("fewer_bytes"),
        (F.col("bytes_saved_pct") > 0).alias("bytes_saved"),
    )


# Quality

def _quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(bindings.staging(spark, sf_dir))


def _required_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost reports, with an empty one for each customer without orders."""
    reports = bindings.staging(spark, sf_dir).select(*quality.REQUIRED_COLUMNS)
    customers = bindings.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 100000).alias("provider_id")
    )
    reported = reports.select("provider_id").distinct()
    silent = customers.join(reported, "provider_id", "left_anti")
    empty = silent.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in reports.schema])
    return quality.required_violations(reports.unionByName(empty))


def _load_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files against a damaged load: rows lost, rows doubled and one column changed."""
    files = _all_columns(staging.read_csv(spark, bindings.external_files(spark, sf_dir)))
    loaded = _all_columns(bindings.staging(spark, sf_dir))
    kept = loaded.filter(F.col("provider_id") % 7 != 0)
    changed = F.when(F.col("provider_id") % 11 == 0, F.col("discharges") + 1).otherwise(F.col("discharges"))
    damaged = kept.unionByName(kept.filter(F.col("provider_id") % 5 == 0)).withColumn("discharges", changed)
    return quality.load_reconciliation(files, damaged)


def _load_reconciliation_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files against a load that is damaged in every tenth range of ids of one year."""
    files = _all_columns(staging.read_csv(spark, bindings.external_files(spark, sf_dir)))
    loaded = _all_columns(bindings.staging(spark, sf_dir))
    provider = F.col("provider_id")
    hit = dates.year_equals(F.col("report_period"), YEAR) & (F.floor(provider / 64) % 10 == 3)
    kept = loaded.filter(~(hit & (provider % 7 == 0)))
    changed = F.when(hit & (provider % 11 == 0), F.col("discharges") + 1).otherwise(F.col("discharges"))
    damaged = kept.unionByName(kept.filter(hit & (provider % 5 == 0))).withColumn("discharges", changed)
    return quality.reconcile_cells(files, damaged)


def _synthetic_hospitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = bindings.table(spark, sf_dir, "customer")
    return generate.generate(customers.select(F.col("c_custkey").alias("id")))


# Scalar functions

def _display_name(stg: DataFrame) -> DataFrame:
    name = text.display_name(F.col("city"), F.col("hospital_name"))
    return stg.select("provider_id", "report_period", name.alias("display_name"))


def _clamped_beds(stg: DataFrame) -> DataFrame:
    beds = F.col("beds_number")
    return stg.select(
        "provider_id", beds, sizes.clamp(beds, 40, 250).cast("bigint").alias("clamped_beds")
    )


def _unit_conversion(objects: DataFrame) -> DataFrame:
    units = {"kb": sizes.KIB, "mb": sizes.MIB, "gb": sizes.GIB, "tb": sizes.TIB}
    return objects.select(
        "object_id",
        *[sizes.in_unit(F.col("size_bytes"), unit).alias(f"size_{n}") for n, unit in units.items()],
    )


def _formatted_year_report(stg: DataFrame) -> DataFrame:
    years = profile.by_year(stg)
    return years.select(
        "year",
        text.thousands(F.col("hospitals")).alias("hospitals"),
        text.whole(F.col("avg_beds")).alias("avg_beds"),
        text.dollars(F.col("total_expenses")).alias("total_expenses"),
        text.dollars(F.col("avg_expenses")).alias("avg_expenses"),
    )


def _batch_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bindings.table(spark, sf_dir, "events")
    name = dates.batch_name(F.col("user_id"), F.col("ts"))
    return events.select("event_id", name.alias("batch_name"))


def _json_row_count(payloads: DataFrame) -> DataFrame:
    return payloads.select("event_id", text.json_rows(F.col("payload")).alias("n"))


# Costs

def _job_totals(jobs: DataFrame) -> DataFrame:
    return cost.narrowed(materialise(cost.job_totals(jobs), "job-totals"))


def _load_costs(operator) -> Query:
    return lambda spark, sf_dir: operator(cost.end_to_end_cost(bindings.load_runs(spark, sf_dir)))


def _storage_cost_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = bindings.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("object_id"), (F.col("n_chars") * 1000000).alias("size_bytes")
    )
    costs = cost.storage_cost(bindings.objects(spark, sf_dir)).select("object_id", "total")
    return cost.storage_cost_joined(files, costs)


def _cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all stored objects at 1, 10, ... times their size."""
    size = F.sum(F.col("size_bytes").cast("decimal(20,0)")).cast("double")
    physical = F.sum(F.col("physical_bytes").cast("decimal(20,0)")).cast("double")
    measured = bindings.objects(spark, sf_dir).agg(
        F.count("*").alias("records"),
        size.alias("csv_bytes"),
        size.alias("logical_bytes"),
        physical.alias("physical_bytes"),
        size.alias("processed_bytes"),
        F.lit(5.4).alias("seconds"),
        F.lit(103.0).alias("memory_mb"),
        F.lit(0).alias("slot_ms"),
    )
    return cost.cost_projection(measured, PROJECTION_FACTORS)


# Run results per engine

def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result record per engine; measures are DECIMAL, so sums are exact."""
    measure = "decimal(18,6)"
    phase = bindings.phases(spark, sf_dir)
    per_phase = phase.groupBy("engine").agg(
        *[
            expression
            for name in ("data_generation", "data_load")
            for expression in (
                F.sum(F.when(F.col("phase") == name, F.col("seconds")))
                .cast(measure)
                .alias(f"{name}_seconds"),
                F.max(F.when(F.col("phase") == name, F.col("memory_mb")))
                .cast(measure)
                .alias(f"{name}_memory_mb"),
            )
        ]
    )
    side = (
        F.when(F.col("object_id") % 3 == 0, "native")
        .when(F.col("object_id") % 3 == 1, "external")
        .otherwise("spark")
    )
    logical, physical = F.col("logical"), F.col("physical")
    stored = (
        bindings.objects(spark, sf_dir)
        .groupBy(side.alias("engine"))
        .agg(
            F.sum(F.col("size_bytes").cast("decimal(20,0)")).cast("double").alias("logical"),
            F.sum(F.col("physical_bytes").cast("decimal(20,0)")).cast("double").alias("physical"),
            F.count("*").alias("num_rows"),
            F.countDistinct("days_stored").alias("num_partitions"),
        )
    )
    jobs = bindings.jobs(spark, sf_dir).groupBy("engine").agg(
        F.sum(F.coalesce("total_bytes_processed", F.lit(0)).cast("decimal(20,0)"))
        .cast("double")
        .alias("processed_bytes"),
        F.sum(F.col("total_slot_ms").cast("decimal(20,0)")).cast("double").alias("slot_ms"),
    )
    costed = cost.with_costs(
        per_phase.join(stored, "engine")
        .join(jobs, "engine")
        .select(
            "*",
            F.col("data_generation_seconds").alias("seconds"),
            F.col("data_generation_memory_mb").alias("memory_mb"),
            logical.alias("csv_bytes"),
            logical.alias("logical_bytes"),
            physical.alias("physical_bytes"),
        )
    )

    def rounded(column):
        return F.round(column, 6).cast(measure)

    return costed.select(
        "engine",
        F.lit("2024-01-01T00:00:00").alias("timestamp"),
        "data_generation_seconds",
        "data_generation_memory_mb",
        "data_load_seconds",
        "data_load_memory_mb",
        rounded(sizes.in_unit(logical, sizes.MIB)).alias("raw_csv_mb"),
        rounded(sizes.in_unit(logical, sizes.MIB)).alias("logical_mb"),
        rounded(sizes.in_unit(physical, sizes.MIB)).alias("physical_mb"),
        rounded(F.try_divide(physical, logical)).alias("compression_ratio"),
        "num_rows",
        "num_partitions",
        rounded("total_usd").alias("total_usd"),
        *[rounded(f"{n}_usd").alias(f"{n}_usd") for n in cost.COMPONENTS],
        F.lit(cost.REGION).alias("pricing_region"),
        F.lit("2024-01-01T00:00:00").alias("pricing_timestamp"),
    )


def _metrics_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = metrics.nested_form(_results(spark, sf_dir), bindings.jobs(spark, sf_dir))
    back = metrics.json_roundtrip(nested)
    return metrics.long_form(metrics.flat_form(back))


def _record(rows) -> Query:
    """Part of the whole result record, after it went to JSON and back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nested = record.record(
            bindings.samples(spark, sf_dir),
            bindings.engine_objects(spark, sf_dir),
            bindings.job_history(spark, sf_dir),
            at="2024-01-01T00:00:00",
        )
        return cost.narrowed(rows(metrics.json_roundtrip(nested)))

    return run


def _recent_jobs(jobs: DataFrame) -> DataFrame:
    return metrics.recent_jobs(jobs).select("engine", F.inline("jobs"))


QUERIES: dict[str, Query] = {
    # flagship workload
    "flagship_q1": _stg(yearly.flagship),
    "flagship_q2": _stg(lambda stg: yearly.flagship(stg, year=YEAR)),
    "flagship_q3": _stg(lambda stg: yearly.flagship(stg, year=YEAR, id_range=ID_RANGE)),
    "flagship_full": _stg(lambda stg: yearly.flagship(stg, limit=None)),
    "flagship_full_by_value": _stg(_flagship_by_value),
    "sql_entry_q1": _stg(lambda stg: yearly.flagship_sql(stg, "stg_hospital_costs_view")),
    "external_q1": _external(yearly.flagship),
    "external_q2": _external(lambda ext: yearly.flagship(ext, year=YEAR)),
    "external_q3": _external(lambda ext: yearly.flagship(ext, year=YEAR, id_range=ID_RANGE)),
    "yearly_summary": _stg(lambda stg: yearly.yearly_summary(yearly.cost_reports(stg))),
    "yearly_summary_sample": _stg(_yearly_summary_sample),
    "cast_date_year": _stg(_cast_date_year),
    "analytics_table": _analytics_table,
    "analytics_top10": _analytics_top10,
    "top5_per_year": _analytics(lambda ranked: yearly.top_k_per_year(ranked, 5)),
    "yoy_growth_counts": _analytics(yearly.growth_counts),
    "rank_distribution": _analytics(yearly.rank_distribution),
    "income_quartiles": _analytics(ranking.income_quartiles),
    "income_quartiles_by_value": _analytics(
        lambda ranked: ranking.income_quartiles(ranked)
    ),
    # staging profile and staging queries
    "total_records": _stg(profile.row_count),
    "count_over_50_beds": _stg(lambda stg: profile.row_count(stg, F.col("beds_number") > 50)),
    "year_distribution": _stg(profile.by_year),
    "state_distribution": _stg(profile.by_state),
    "bed_size_categories": _stg(profile.bed_size_categories),
    "financial_summary": _stg(profile.financial_summary),
    "profile_stats": _stg(profile.numeric_profile),
    "preview_ordered": _stg(profile.preview),
    "top_expense_hospitals": _stg(profile.top_expense_hospitals),
    "top_expense_preview": _stg(profile.top_expense_preview),
    "yearly_comparison_filtered": _stg(profile.by_year_filtered),
    "state_analysis": _stg(profile.state_analysis),
    "size_category_filtered": _stg(profile.size_categories_filtered),
    "profit_margin": _stg(lambda stg: profile.profit_margin(stg, min_expenses=MIN_EXPENSES)),
    # sources, sinks and metadata
    "stg_binding": lambda spark, sf_dir: _all_columns(bindings.cost_reports(spark, sf_dir)),
    "csv_roundtrip": _csv_roundtrip,
    "csv_load": _csv_load,
    "staging_roundtrip": _load(["overwrite"]),
    "load_overwrite": _load(["overwrite", "overwrite"]),
    "load_append": _load(["overwrite", "append"]),
    "table_recreate": _table_recreate,
    "versioned_load": _versioned_load,
    "external_renamed_scan": _external_renamed_scan,
    "external_multi_file_scan": _external_multi_file_scan,
    "external_copies_summary": _external_copies_summary,
    "latest_batch": _latest_batch,
    "partition_counts": _partition_counts,
    "scan_reduction": _stg(_scan_reduction),
    "scan_reduction_measured": _stg(_scan_reduction_measured),
    "storage_metrics": _storage_metrics,
    "table_storage": _table_storage,
    "load_measures": _load_measures,
    # quality and generation
    "dq_report": _quality_report,
    "required_violations": _required_violations,
    "load_reconciliation": _load_reconciliation,
    "load_reconciliation_cells": _load_reconciliation_cells,
    "synthetic_hospitals": _synthetic_hospitals,
    # scalar functions
    "hospital_display_name": _stg(_display_name),
    "clamped_beds": _stg(_clamped_beds),
    "unit_conversion": _on(bindings.objects, _unit_conversion),
    "formatted_year_report": _stg(_formatted_year_report),
    "batch_name": _batch_name,
    "json_row_count": _on(bindings.payloads, _json_row_count),
    # costs
    "query_cost": _on(bindings.jobs, cost.query_cost),
    "job_billed_cost": _on(bindings.jobs, cost.job_billed_cost),
    "job_totals": _on(bindings.jobs, _job_totals),
    "warehouse_storage_cost": _on(bindings.objects, cost.warehouse_storage_cost),
    "storage_cost": _on(bindings.objects, cost.storage_cost),
    "storage_cost_joined": _storage_cost_joined,
    "compute_cost": _on(bindings.usage, cost.compute_cost),
    "network_cost": _on(bindings.usage, cost.network_cost),
    "end_to_end_cost": _load_costs(lambda costs: costs),
    "cost_share": _load_costs(cost.cost_share),
    "cost_projection": _cost_projection,
    # comparisons and run results
    "benchmark_summary": _on(bindings.runs, benchmark.benchmark_summary),
    "benchmark_overall": _on(bindings.runs, benchmark.benchmark_overall),
    "engine_comparison": _on(bindings.phases, benchmark.engine_comparison),
    "engine_cost_comparison": _on(bindings.jobs, benchmark.engine_cost_comparison),
    "phase_rollup": _on(bindings.phases, benchmark.phase_rollup),
    "resource_samples_summary": _on(bindings.phases, benchmark.resource_samples_summary),
    "storage_ratio": _on(bindings.objects, benchmark.storage_ratio),
    "metrics_long_form": _on(_results, lambda r: metrics.csv_roundtrip(metrics.long_form(r))),
    "metrics_json_roundtrip": _metrics_json_roundtrip,
    "record_performance": _record(record.performance_rows),
    "record_storage": _record(record.storage_rows),
    "record_jobs": _record(record.job_rows),
    "record_costs": _record(record.cost_rows),
    "recent_jobs": _on(bindings.jobs, _recent_jobs),
}
