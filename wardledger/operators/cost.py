"""Costs of queries, storage, compute and network from usage tables."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardledger.functions.sizes import GIB, TIB, in_unit

# List prices in USD. The class A and B operation rates are
# charged per 10,000 operations.
RATES = [
    ("query", "on_demand", "TB", 5.0),
    ("query", "slot", "slot hour", 0.04),
    ("table_storage", "active", "GB month", 0.02),
    ("table_storage", "longterm", "GB month", 0.01),
    ("table_storage", "streaming_inserts", "GB", 0.01),
    ("object_storage", "standard_regional", "GB month", 0.023),
    ("object_storage", "standard_multiregional", "GB month", 0.026),
    ("object_storage", "standard_dualregional", "GB month", 0.022),
    ("object_storage", "operations_class_a", "10000 operations", 0.005),
    ("object_storage", "operations_class_b", "10000 operations", 0.0004),
    ("object_storage", "network_egress", "GB", 0.12),
    ("compute", "e2-micro", "vcpu hour", 0.00478),
    ("compute", "e2-micro memory", "GB hour", 0.00478),
    ("compute", "e2-small", "vcpu hour", 0.02),
    ("compute", "e2-medium", "vcpu hour", 0.03),
    ("compute", "e2-standard", "vcpu hour", 0.03),
    ("compute", "memory", "GB hour", 0.004),
    ("network", "egress", "GB", 0.12),
    ("network", "ingress", "GB", 0.0),
]

# Thresholds and free allowances.
DAYS_PER_MONTH = 30.0
ACTIVE_DAYS = 90
FREE_MICRO_HOURS = 744
FREE_EGRESS_GB = 1024.0
OPERATIONS_PER_UNIT = 10000
DEFAULT_STORAGE_CLASS = "standard_regional"
STORAGE_CLASSES = ["standard_regional", "standard_multiregional", "standard_dualregional"]
REGION = "us-central1"

COMPONENTS = ["cloud_storage", "query", "table_storage", "compute", "network"]

_USD = {(service, item): usd for service, item, _, usd in RATES}


def _rate(service: str, item: str) -> Column:
    return F.lit(_USD[service, item])


def rate_card(spark: SparkSession) -> DataFrame:
    """The nineteen rates as a table."""
    rows = ", ".join(f"('{s}', '{i}', '{u}', {usd!r}D)" for s, i, u, usd in RATES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rates(service, item, unit, usd)")


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def on_demand_usd(size_bytes: Column) -> Column:
    return in_unit(_or_zero(size_bytes), TIB) * _rate("query", "on_demand")


def slot_usd(slot_ms: Column) -> Column:
    return _or_zero(slot_ms).cast("double") / F.lit(3600000.0) * _rate("query", "slot")


def cheaper_usd(on_demand: Column, slot: Column) -> Column:
    """The lower of the two prices; on demand where no slot time was used."""
    return F.when(slot > 0, F.least(on_demand, slot)).otherwise(on_demand)


def _months(days: Column) -> Column:
    return days.cast("double") / F.lit(DAYS_PER_MONTH)


def active_usd(logical_bytes: Column, days: Column) -> Column:
    """Active storage is charged for the whole time, also past 90 days."""
    return in_unit(logical_bytes, GIB) * _rate("table_storage", "active") * _months(days)


def longterm_usd(physical_bytes: Column, days: Column) -> Column:
    """Long-term storage adds to the active charge from day 91."""
    charge = (
        in_unit(physical_bytes, GIB)
        * _rate("table_storage", "longterm")
        * _months(days - ACTIVE_DAYS)
    )
    return F.when(days > ACTIVE_DAYS, charge).otherwise(F.lit(0.0))


def object_usd(size_bytes: Column, rate: Column, days: Column) -> Column:
    return in_unit(size_bytes, GIB) * rate * _months(days)


def upload_usd() -> Column:
    """One class A operation."""
    return _rate("object_storage", "operations_class_a") / F.lit(float(OPERATIONS_PER_UNIT))


def compute_base_usd(machine: Column, vcpu_hours: Column, memory_hours: Column) -> Column:
    """Small machines have one price per hour; others pay memory as well."""
    vcpu, memory = vcpu_hours.cast("double"), memory_hours.cast("double")
    return (
        F.when(machine == "e2-micro", vcpu * _rate("compute", "e2-micro"))
        .when(machine == "e2-small", vcpu * _rate("compute", "e2-small"))
        .when(machine == "e2-medium", vcpu * _rate("compute", "e2-medium"))
        .otherwise(vcpu * _rate("compute", "e2-standard") + memory * _rate("compute", "memory"))
    )


def compute_discount_usd(machine: Column, vcpu_hours: Column, base: Column) -> Column:
    """e2-micro is free up to 744 hours; past that nothing is free."""
    free = (machine == "e2-micro") & (vcpu_hours <= FREE_MICRO_HOURS)
    allowance = vcpu_hours.cast("double") * _rate("compute", "e2-micro")
    return F.when(free, F.least(base, allowance)).otherwise(F.lit(0.0))


def after_discount(base: Column, discount: Column) -> Column:
    return F.greatest(F.lit(0.0), base - discount)


def billable_gb(egress_gb: Column) -> Column:
    return F.greatest(F.lit(0.0), egress_gb - F.lit(FREE_EGRESS_GB))


def network_usd(egress_gb: Column) -> Column:
    """Egress past the free terabyte; ingress is free."""
    return billable_gb(egress_gb) * _rate("network", "egress")


def query_cost(jobs: DataFrame) -> DataFrame:
    on_demand = on_demand_usd(F.col("total_bytes_processed"))
    slot = slot_usd(F.col("total_slot_ms"))
    return jobs.select(
        "job_id",
        on_demand.alias("on_demand"),
        slot.alias("slot"),
        cheaper_usd(on_demand, slot).alias("recommended"),
    )


def job_billed_cost(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", on_demand_usd(F.col("total_bytes_billed")).alias("cost"))


#: Type of ``whole_sum``.
WHOLE = "decimal(30,0)"


def whole_sum(value: Column) -> Column:
    """Exact sum of BIGINT values as DECIMAL: totals of many jobs leave the range of BIGINT."""
    return F.sum(value.cast("decimal(20,0)"))


def narrowed(totals: DataFrame) -> DataFrame:
    """Whole sums as BIGINT; a column with a value beyond BIGINT stays the exact DECIMAL.

    ``totals`` is read once to see which values fit.
    """
    wide = [f.name for f in totals.schema if f.dataType.simpleString() == WHOLE]
    if not wide:
        return totals
    beyond = totals.agg(
        *[F.count_if(F.col(n).isNotNull() & F.col(n).try_cast("bigint").isNull()).alias(n) for n in wide]
    ).first()
    return totals.withColumns({n: F.col(n).cast("bigint") for n in wide if not beyond[n]})


def _sum_integers(name: str) -> Column:
    return whole_sum(_or_zero(F.col(name)))


def job_totals(jobs: DataFrame) -> DataFrame:
    """Bytes, slot time and billed cost over all jobs; bytes and slot time are whole sums.

    The cost comes from the exact sum of billed bytes.
    """
    return jobs.agg(
        F.count("*").alias("jobs"),
        _or_zero(_sum_integers("total_bytes_processed")).alias("bytes_processed"),
        _or_zero(_sum_integers("total_slot_ms")).alias("slot_ms"),
        on_demand_usd(_sum_integers("total_bytes_billed")).alias("cost"),
    )


def warehouse_storage_cost(objects: DataFrame) -> DataFrame:
    days = F.col("days_stored")
    active = active_usd(F.col("size_bytes"), days)
    longterm = longterm_usd(F.col("physical_bytes"), days)
    return objects.select(
        "object_id",
        active.alias("active"),
        longterm.alias("longterm"),
        (active + longterm).alias("total"),
    )


def storage_cost(objects: DataFrame) -> DataFrame:
    """Object storage by storage class; unknown classes pay the regional rate."""
    classes = rate_card(objects.sparkSession).filter(
        (F.col("service") == "object_storage") & F.col("item").isin(STORAGE_CLASSES)
    )
    # Three rows of the rate card, whatever the size of the usage table.
    priced = objects.join(
        F.broadcast(classes.select(F.col("item").alias("storage_class"), "usd")),
        "storage_class",
        "left",
    )
    rate = F.coalesce(F.col("usd"), _rate("object_storage", DEFAULT_STORAGE_CLASS))
    storage = object_usd(F.col("size_bytes"), rate, F.col("days_stored"))
    return priced.select(
        "object_id",
        rate.alias("rate"),
        storage.alias("storage"),
        upload_usd().alias("operations"),
        (storage + upload_usd()).alias("total"),
    )


def storage_cost_joined(files: DataFrame, costs: DataFrame) -> DataFrame:
    """Attach file sizes to the costs of the objects they belong to (1:1)."""
    return files.join(costs, "object_id", "left").select("object_id", "size_bytes", "total")


def compute_cost(usage: DataFrame) -> DataFrame:
    machine, hours = F.col("machine_type"), F.col("vcpu_hours")
    priced = usage.select(
        "run_id",
        compute_base_usd(machine, hours, F.col("memory_gb_hours")).alias("base"),
        machine,
        hours,
    ).withColumn("discount", compute_discount_usd(machine, hours, F.col("base")))
    return priced.select(
        "run_id", "base", "discount", after_discount(F.col("base"), F.col("discount")).alias("total")
    )


def network_cost(usage: DataFrame) -> DataFrame:
    gb = in_unit(F.col("egress_bytes"), GIB)
    return usage.select(
        "run_id",
        gb.alias("egress_gb"),
        billable_gb(gb).alias("billable_gb"),
        F.least(gb, F.lit(FREE_EGRESS_GB)).alias("free_gb"),
        network_usd(gb).alias("cost"),
    )


def with_costs(runs: DataFrame) -> DataFrame:
    """Add the five cost parts of a load run and their total.

    ``runs`` has ``seconds, memory_mb, csv_bytes, logical_bytes,
    physical_bytes, processed_bytes, slot_ms``. Storage is charged for 30
    days, the client is an e2-micro, and the CSV bytes leave once.
    """
    days, machine = F.lit(int(DAYS_PER_MONTH)), F.lit("e2-micro")
    hours = F.col("seconds").cast("double") / F.lit(3600.0)
    memory_hours = F.col("memory_mb").cast("double") / F.lit(1024.0) * hours
    base = compute_base_usd(machine, hours, memory_hours)
    regional = _rate("object_storage", DEFAULT_STORAGE_CLASS)
    parts = {
        "cloud_storage": object_usd(F.col("csv_bytes"), regional, days) + upload_usd(),
        "query": cheaper_usd(on_demand_usd(F.col("processed_bytes")), slot_usd(F.col("slot_ms"))),
        "table_storage": active_usd(F.col("logical_bytes"), days)
        + longterm_usd(F.col("physical_bytes"), days),
        "compute": after_discount(base, compute_discount_usd(machine, hours, base)),
        "network": network_usd(in_unit(F.col("csv_bytes"), GIB)),
    }
    costs = runs.select("*", *[part.alias(f"{name}_usd") for name, part in parts.items()])
    total = F.col(f"{COMPONENTS[0]}_usd")
    for name in COMPONENTS[1:]:
        total = total + F.col(f"{name}_usd")
    return costs.select("*", total.alias("total_usd"))


def end_to_end_cost(runs: DataFrame) -> DataFrame:
    """The cost parts and total of every load run ``run_id``."""
    return with_costs(runs).select(
        "run_id", *[f"{name}_usd" for name in COMPONENTS], "total_usd"
    )


def cost_record(costs: DataFrame) -> DataFrame:
    """Nested form of ``end_to_end_cost``: total, breakdown, region."""
    breakdown = F.struct(*[F.col(f"{name}_usd") for name in COMPONENTS])
    return costs.select(
        "run_id",
        F.struct(
            "total_usd", breakdown.alias("cost_breakdown"), F.lit(REGION).alias("pricing_region")
        ).alias("cost_metrics"),
    )


def _exact_sum(name: str) -> Column:
    """Sum of a DOUBLE column that no order of tasks changes, in steps of 1e-18 dollars."""
    return F.coalesce(F.sum(F.col(name).cast("decimal(38,18)")), F.lit(0)).cast("double")


def cost_share(costs: DataFrame) -> DataFrame:
    """Sum of each cost part over all runs and its share of the total; only the results are rounded."""
    sums = costs.agg(*[_exact_sum(f"{name}_usd").alias(name) for name in COMPONENTS])
    total = F.col(COMPONENTS[0])
    for name in COMPONENTS[1:]:
        total = total + F.col(name)
    rows = [
        F.struct(
            F.lit(name).alias("component"),
            F.round(F.col(name), 6).alias("usd"),
            F.round(F.try_divide(F.col(name), total), 6).alias("share"),
        )
        for name in COMPONENTS
    ]
    return sums.select(F.inline(F.array(*rows)))


def cost_projection(measured: DataFrame, factors: list[int]) -> DataFrame:
    """Cost of a measured dataset at multiples of its size.

    ``measured`` is one row of ``records, csv_bytes, logical_bytes,
    physical_bytes, processed_bytes, seconds, memory_mb, slot_ms``.
    """
    grown = ["records", "csv_bytes", "logical_bytes", "physical_bytes", "processed_bytes"]
    kept = ["seconds", "memory_mb", "slot_ms"]
    sized = measured.select(
        *measured.columns, F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor")
    ).select(*[(F.col(c).cast("double") * F.col("factor")).alias(c) for c in grown], *kept)
    costs = end_to_end_cost(sized.withColumnRenamed("records", "run_id"))
    return costs.select(F.col("run_id").cast("bigint").alias("records"), *costs.columns[1:])
