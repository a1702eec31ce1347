"""The engine's input tables, derived from the tables of a data folder."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardledger.functions.dates import batch_name, year_end
from wardledger.functions.money import from_units, hundredths
from wardledger.operators.yearly import flagship
from wardledger.schema import NATIVE_SCHEMA, PARTITION_COLUMN
from wardledger.session import fresh_path
from wardledger.sources.landing import land
from wardledger.sources.staging import read_staging, write_csv, write_staging

MONEY2 = "decimal(12,2)"
COPIES = 8
DAY_COUNTS = {
    "patient_days": 275,
    "discharges": 30,
    "fte_employees": 5,
    "medicare_days": 140,
    "medicaid_days": 75,
}
STAGED_COLUMNS = [
    "provider_id",
    "hospital_name",
    "city",
    "state",
    "beds_number",
    "report_period",
    "total_expenses",
    "total_charges",
    "net_income",
]

_written: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, build):
    """Build a written table once per application and data folder."""
    key = (spark.conf.get("spark.app.id"), sf_dir, label)
    if key not in _written:
        _written[key] = build()
    return _written[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cost_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen-column cost reports from orders and their line items.

    Customers and nations are joined without hints: adaptive execution
    broadcasts them when their measured size allows and splits skewed keys
    otherwise. Line items are summed up per order before the join, as whole
    hundredths and ten-thousandths: a sum of BIGINT has a third of the bytes of
    a wide DECIMAL in the shuffle and needs no object for a row.
    """
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        hundredths(F.col("l_extendedprice"), 12).alias("price"),
        (100 - hundredths(F.col("l_discount"), 4)).alias("kept"),
    )
    lines = (
        items.groupBy("l_orderkey")
        .agg(F.sum("price").alias("charges"), F.sum(F.col("price") * F.col("kept")).alias("net"))
        .select(
            "l_orderkey",
            from_units(F.col("charges"), 18, 2).alias("total_charges"),
            from_units(F.col("net"), 18, 4).alias("net_charges"),
        )
    )
    expenses = from_units(hundredths(F.col("o_totalprice"), 18), 18, 2)
    beds = F.lit(25) + (F.col("o_custkey") * 7) % 300
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey)
        .join(customer, customer.c_custkey == orders.o_custkey)
        .join(nation, nation.n_nationkey == customer.c_nationkey)
        .select(
            (F.col("o_custkey") + 100000).alias("provider_id"),
            F.col("c_name").alias("hospital_name"),
            F.col("c_mktsegment").alias("city"),
            F.col("n_name").alias("state"),
            beds.cast("int").alias("beds_number"),
            year_end(F.col("o_orderdate")).alias("report_period"),
            expenses.alias("total_expenses"),
            "total_charges",
            (F.col("net_charges") - expenses).cast("decimal(18,4)").alias("net_income"),
            *[(beds * k).cast("bigint").alias(name) for name, k in DAY_COUNTS.items()],
        )
    )


def staging_path(spark: SparkSession, sf_dir: str) -> str:
    def build() -> str:
        path = fresh_path(spark, "staging")
        write_staging(cost_reports(spark, sf_dir).to(NATIVE_SCHEMA), path)
        return path

    return _once(spark, sf_dir, "staging", build)


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loaded staging table: written once, then only read."""
    return read_staging(spark, staging_path(spark, sf_dir))


def external_files(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the cost reports as compressed CSV files."""

    def build() -> str:
        path = fresh_path(spark, "external")
        write_csv(staging_order(staging(spark, sf_dir)), path, compressed=True)
        return f"{path}/*.csv.gz"

    return _once(spark, sf_dir, "external", build)


def external_copies(spark: SparkSession, sf_dir: str) -> str:
    """Folders with eight copies of the cost reports, as compressed CSV files."""

    def build() -> str:
        path = fresh_path(spark, "external-copies")
        reports = staging_order(staging(spark, sf_dir))
        for copy in range(COPIES):
            write_csv(reports, f"{path}/{copy}", compressed=True)
        return f"{path}/*/*.csv.gz"

    return _once(spark, sf_dir, "external-copies", build)


def staging_order(stg: DataFrame) -> DataFrame:
    """Columns in file order; a partitioned table reads its key last."""
    return stg.select(*STAGED_COLUMNS, *DAY_COUNTS)


def landing(spark: SparkSession, sf_dir: str) -> str:
    """Landing folder: the cost reports of one year are one batch.

    A batch is named after its row count and the last order in it.
    """

    def build() -> str:
        path = fresh_path(spark, "landing")
        stamps = (
            table(spark, sf_dir, "orders")
            .groupBy(year_end(F.col("o_orderdate")).alias(PARTITION_COLUMN))
            .agg(F.max("o_orderdate").alias("loaded_at"))
        )
        stg = staging(spark, sf_dir)
        named = (
            stg.groupBy(PARTITION_COLUMN)
            .agg(F.count("*").alias("n"))
            .join(stamps, PARTITION_COLUMN)
            .select(PARTITION_COLUMN, batch_name(F.col("n"), F.col("loaded_at")).alias("batch_name"))
        )
        # One row per report period.
        land(staging_order(stg).join(named, PARTITION_COLUMN).select(
            *STAGED_COLUMNS, *DAY_COUNTS, "batch_name"), path)
        return path

    return _once(spark, sf_dir, "landing", build)


def analytics_path(spark: SparkSession, sf_dir: str) -> str:
    """The materialised result of the flagship query without a limit."""

    def build() -> str:
        path = fresh_path(spark, "analytics")
        flagship(staging(spark, sf_dir), limit=None).write.parquet(path)
        return path

    return _once(spark, sf_dir, "analytics", build)


def analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(analytics_path(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded query runs."""
    query = (
        F.when(F.col("user_id") % 3 == 0, "Query_1_Original")
        .when(F.col("user_id") % 3 == 1, "Query_2_Year_Filtered")
        .otherwise("Query_3_Multi_Filtered")
    )
    return table(spark, sf_dir, "events").select(
        query.alias("query_name"),
        F.when(F.col("event_id") % 2 == 0, "native").otherwise("external").alias("table_type"),
        F.col("value").cast(MONEY2).alias("t"),
        (F.col("event_type") != "error").alias("success"),
    )


def _engine():
    return (
        F.when(F.col("user_id") % 3 == 0, "native")
        .when(F.col("user_id") % 3 == 1, "external")
        .otherwise("spark")
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job history; every 11th job has no byte count."""
    size = F.col("event_id") * 1000000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("job_id"),
        _engine().alias("engine"),
        F.col("ts").alias("creation_time"),
        F.when(F.col("event_id") % 11 != 0, size).alias("total_bytes_processed"),
        F.greatest(size, F.lit(10485760)).alias("total_bytes_billed"),
        ((F.col("event_id") % 7) * 5000).alias("total_slot_ms"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects."""
    storage_class = (
        F.when(F.col("lang") == "en", "standard_regional")
        .when(F.col("lang") == "fr", "standard_multiregional")
        .when(F.col("lang") == "de", "standard_dualregional")
        .otherwise("archive")
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("object_id"),
        (F.col("n_chars") * 1000000).alias("size_bytes"),
        (F.col("n_chars") * 2000000).alias("physical_bytes"),
        (F.col("doc_id") % 180).alias("days_stored"),
        storage_class.alias("storage_class"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compute hours and egress."""
    machine = (
        F.when(F.col("event_type") == "view", "e2-small")
        .when(F.col("event_type") == "signup", "e2-medium")
        .when(F.col("event_type") == "purchase", "e2-standard")
        .otherwise("e2-micro")
    )
    value = F.col("value").cast(MONEY2)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        machine.alias("machine_type"),
        (value * 5).alias("vcpu_hours"),
        (value * 2).alias("memory_gb_hours"),
        (F.col("event_id") * 1000000000).alias("egress_bytes"),
    )


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase timings and resource samples per engine."""
    phase = (
        F.when(F.col("event_type") == "view", "data_generation")
        .when(F.col("event_type") == "click", "data_load")
        .otherwise("analytics")
    )
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        _engine().alias("engine"),
        phase.alias("phase"),
        F.col("value").cast(MONEY2).alias("seconds"),
        (F.col("event_id") % 101).cast("int").alias("cpu_percent"),
        (F.lit(100) + F.col("event_id") % 50).cast("int").alias("memory_mb"),
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples with the time they were taken."""
    at = table(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), F.col("ts").alias("at"))
    return phases(spark, sf_dir).join(at, "sample_id")


def engine_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored objects of the engines; one engine has none, and one has no jobs."""
    owner = F.when(F.col("object_id") % 3 == 0, "native").when(F.col("object_id") % 3 == 1, "external").otherwise("archive")
    return objects(spark, sf_dir).select(
        owner.alias("engine"), "size_bytes", "physical_bytes", F.col("days_stored").alias("partition")
    )


def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with kind, state, times and changed rows; a failed event is a job that still runs."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "QUERY").when(F.col("event_type") == "click", "LOAD").otherwise("COPY")
    more = events.select(
        F.col("event_id").alias("job_id"),
        kind.alias("job_type"),
        F.when(F.col("event_type") == "error", "RUNNING").otherwise("DONE").alias("state"),
        (F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 60)).alias("start_time"),
        F.when(kind == "LOAD", F.col("event_id") % 1000).alias("num_dml_affected_rows"),
    )
    end = F.col("start_time") + F.make_dt_interval(secs=F.col("total_slot_ms") / 1000)
    return jobs(spark, sf_dir).join(more, "job_id").withColumn("end_time", F.when(F.col("state") == "DONE", end))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays as a query service returns them."""
    repeated = F.repeat(F.concat("props", F.lit(",")), (F.col("event_id") % 3).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.concat(F.lit("["), repeated, "props", F.lit("]")).alias("payload")
    )


def load_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load run per job, with the sample and the object of the same id."""
    samples = phases(spark, sf_dir).select(
        F.col("sample_id").alias("run_id"), "seconds", "memory_mb"
    )
    jobs_ = jobs(spark, sf_dir).select(
        F.col("job_id").alias("run_id"),
        F.col("total_bytes_processed").alias("processed_bytes"),
        F.col("total_slot_ms").alias("slot_ms"),
    )
    stored = objects(spark, sf_dir).select(
        F.col("object_id").alias("run_id"), "size_bytes", "physical_bytes"
    )
    joined = samples.join(jobs_, "run_id").join(stored, "run_id", "left")
    size = F.coalesce(F.col("size_bytes"), F.lit(0))
    return joined.select(
        "run_id",
        "seconds",
        "memory_mb",
        size.alias("csv_bytes"),
        size.alias("logical_bytes"),
        F.coalesce(F.col("physical_bytes"), F.lit(0)).alias("physical_bytes"),
        F.coalesce(F.col("processed_bytes"), F.lit(0)).alias("processed_bytes"),
        "slot_ms",
    )
