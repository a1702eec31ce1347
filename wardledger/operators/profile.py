"""Profiles of the staging table: by year, state and size, and overall."""

from pyspark.sql import Column, DataFrame, functions as F

from wardledger.functions.dates import report_year
from wardledger.functions import sums
from wardledger.functions.money import percent, ratio
from wardledger.functions.sizes import CATEGORY_BANDS, PROFILE_BANDS
from wardledger.functions.sums import average, count, count_if, largest, mean, smallest, spread, summarise, total
from wardledger.session import materialise


YEAR_MEASURES = {
    "hospitals": count(),
    "avg_beds": average("beds_number"),
    "total_expenses": total("total_expenses"),
    "avg_expenses": mean("total_expenses"),
}
STATE_MEASURES = {"hospitals": count(), "avg_beds": average("beds_number"), "avg_expenses": mean("total_expenses")}
SIZE_MEASURES = {"hospitals": count(), "avg_expenses": mean("total_expenses"), "avg_net_income": mean("net_income")}
FINANCIAL_MEASURES = {
    "min_expenses": smallest("total_expenses"),
    "max_expenses": largest("total_expenses"),
    "avg_expenses": mean("total_expenses"),
    "stddev_expenses": spread("total_expenses"),
    "min_net_income": smallest("net_income"),
    "max_net_income": largest("net_income"),
    "avg_net_income": mean("net_income"),
    "loss_making_hospitals": count_if("net_income < 0"),
}

#: What ``staging_profile`` reads of a table.
PROFILE_COLUMNS = ["report_period", "state", "beds_number", "total_expenses", "net_income"]


def row_count(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One row with the number of rows (that satisfy the predicate)."""
    kept = df if predicate is None else df.filter(predicate)
    return kept.agg(F.count("*").alias("count"))


def preview(stg: DataFrame, rows: int = 5) -> DataFrame:
    """First cost reports by period and provider."""
    columns = [
        "provider_id",
        "hospital_name",
        "city",
        "state",
        "beds_number",
        "report_period",
        "total_expenses",
    ]
    return (
        stg.select(*columns)
        .orderBy(F.asc_nulls_first("report_period"), "provider_id", "total_expenses")
        .limit(rows)
    )


def by_year(stg: DataFrame) -> DataFrame:
    return summarise(stg, {"year": report_year(F.col("report_period"))}, YEAR_MEASURES).orderBy("year")


def by_year_filtered(stg: DataFrame, min_beds: int = 50) -> DataFrame:
    return summarise(
        stg.filter(F.col("beds_number") > min_beds),
        {"report_year": report_year(F.col("report_period"))},
        {
            "hospital_count": count(),
            "avg_beds": average("beds_number"),
            "total_expenses": total("total_expenses"),
            "avg_expenses": mean("total_expenses"),
            "total_net_income": total("net_income"),
            "avg_net_income": mean("net_income"),
        },
    ).orderBy("report_year")


def by_state(stg: DataFrame, top: int = 10) -> DataFrame:
    return (
        summarise(stg, {"state": F.col("state")}, STATE_MEASURES)
        .orderBy(F.desc("hospitals"), "state")
        .limit(top)
    )


def state_analysis(stg: DataFrame, min_beds: int = 50, min_count: int = 2) -> DataFrame:
    """States with at least ``min_count`` reports of large enough hospitals.

    The mean of ratios adds up the ratios of single reports, exactly as amounts are.
    """
    charge_ratio = ratio(F.col("total_charges"), F.col("total_expenses"))
    states = summarise(
        stg.filter(F.col("beds_number") > min_beds).withColumn("charge_ratio", charge_ratio),
        {"state": F.col("state")},
        {
            "hospital_count": count(),
            "avg_beds": average("beds_number"),
            "avg_expenses": mean("total_expenses"),
            "avg_net_income": mean("net_income"),
            "avg_charge_ratio": mean("charge_ratio"),
        },
    )
    return (
        states.withColumn("avg_charge_ratio", F.round("avg_charge_ratio", 2))
        .filter(F.col("hospital_count") >= min_count)
        .orderBy(F.desc("avg_expenses"))
    )


def bed_size_categories(stg: DataFrame) -> DataFrame:
    bands = {"size_category": PROFILE_BANDS.label(F.col("beds_number"))}
    return summarise(stg, bands, SIZE_MEASURES).orderBy(PROFILE_BANDS.position(F.col("size_category")))


def size_categories_filtered(stg: DataFrame, min_beds: int = 50) -> DataFrame:
    rows = stg.filter(F.col("beds_number") > min_beds).withColumn("income", F.col("net_income").cast("double"))
    return summarise(
        rows,
        {"size_category": CATEGORY_BANDS.label(F.col("beds_number"))},
        {
            "hospital_count": count(),
            "avg_expenses": mean("total_expenses"),
            "avg_net_income": mean("net_income"),
            "min_net_income": smallest("income"),
            "max_net_income": largest("income"),
        },
    ).orderBy(CATEGORY_BANDS.position(F.col("size_category")))


def _doubles(stg: DataFrame) -> DataFrame:
    return stg.withColumns({name: F.col(name).cast("double") for name in ("total_expenses", "net_income")})


def financial_summary(stg: DataFrame) -> DataFrame:
    """Range, mean and spread of expenses and income over all reports."""
    return _rounded_spread(summarise(_doubles(stg), {}, FINANCIAL_MEASURES))


def _rounded_spread(summary: DataFrame) -> DataFrame:
    return summary.withColumn("stddev_expenses", F.round("stddev_expenses", 2))


def numeric_profile(stg: DataFrame) -> DataFrame:
    """Range and mean of beds and expenses, and hospitals over 50 beds."""
    return summarise(
        _doubles(stg).withColumn("beds", F.col("beds_number").cast("bigint")),
        {},
        {
            "min_beds": smallest("beds"),
            "max_beds": largest("beds"),
            "avg_beds": average("beds_number"),
            "min_expenses": smallest("total_expenses"),
            "max_expenses": largest("total_expenses"),
            "avg_expenses": mean("total_expenses"),
            "over_50_beds": count_if("beds_number > 50"),
        },
    )


def top_expense_hospitals(stg: DataFrame, min_beds: int = 50, rows: int = 20) -> DataFrame:
    charge_ratio = ratio(F.col("total_charges"), F.col("total_expenses"))
    return (
        stg.filter(F.col("beds_number") > min_beds)
        .select(
            "provider_id",
            "hospital_name",
            "city",
            "state",
            "beds_number",
            report_year(F.col("report_period")).alias("report_year"),
            F.col("total_expenses").cast("double").alias("total_expenses"),
            F.col("total_charges").cast("double").alias("total_charges"),
            F.col("net_income").cast("double").alias("net_income"),
            F.round(charge_ratio, 2).alias("charge_to_expense_ratio"),
        )
        .orderBy(
            F.desc("total_expenses"),
            "provider_id",
            "report_year",
            "total_charges",
            "net_income",
        )
        .limit(rows)
    )


def top_expense_preview(stg: DataFrame, min_beds: int = 50, rows: int = 10) -> DataFrame:
    return (
        stg.filter(F.col("beds_number") > min_beds)
        .select(
            "provider_id",
            "hospital_name",
            "beds_number",
            report_year(F.col("report_period")).alias("report_year"),
            F.col("total_expenses").cast("double").alias("total_expenses"),
        )
        .orderBy(F.desc("total_expenses"), "provider_id", "report_year")
        .limit(rows)
    )


def profit_margin(
    stg: DataFrame,
    min_beds: int = 100,
    min_expenses: int = 50_000_000,
    rows: int = 50,
) -> DataFrame:
    """Best profit margins among large, expensive hospitals."""
    margin = percent(F.col("net_income"), F.col("total_expenses"))
    return (
        stg.filter(
            (F.col("beds_number") > min_beds)
            & (F.col("total_expenses") > min_expenses)
            & F.col("net_income").isNotNull()
        )
        .select(
            "provider_id",
            "hospital_name",
            report_year(F.col("report_period")).alias("report_year"),
            "beds_number",
            F.col("total_expenses").cast("double").alias("total_expenses"),
            F.col("net_income").cast("double").alias("net_income"),
            F.round(margin, 2).alias("profit_margin_pct"),
        )
        .orderBy(
            F.desc("profit_margin_pct"),
            F.desc("total_expenses"),
            "provider_id",
            "report_year",
            "net_income",
        )
        .limit(rows)
    )


def staging_profile(stg: DataFrame) -> dict[str, DataFrame]:
    """The five result sets of the load report from a single scan.

    The scan leaves a small table of cells, one for each year, state and size band, with sums
    of limbs; each result adds up cells. The results equal those of the functions that scan on
    their own, to the bit.
    """
    rows = _doubles(stg)
    by = {
        "year": report_year(F.col("report_period")),
        "state": F.col("state"),
        "size_category": PROFILE_BANDS.label(F.col("beds_number")),
    }
    asked = {
        "total_records": ([], {"count": count()}),
        "year_distribution": (["year"], YEAR_MEASURES),
        "state_distribution": (["state"], STATE_MEASURES),
        "bed_size_categories": (["size_category"], SIZE_MEASURES),
        "financial_summary": ([], FINANCIAL_MEASURES),
    }
    # The spread first: sums of a column are named after the first measure that asks for it.
    every = {**FINANCIAL_MEASURES, **YEAR_MEASURES, **STATE_MEASURES, **SIZE_MEASURES, "count": count()}
    cells = materialise(sums.partial(rows, by, every), "profile-cells")
    found = {name: sums.combine(rows, cells, keys, every).select(*keys, *measures) for name, (keys, measures) in asked.items()}
    return {
        "total_records": found["total_records"],
        "year_distribution": found["year_distribution"].orderBy("year"),
        "state_distribution": found["state_distribution"].orderBy(F.desc("hospitals"), "state").limit(10),
        "bed_size_categories": found["bed_size_categories"].orderBy(PROFILE_BANDS.position(F.col("size_category"))),
        "financial_summary": _rounded_spread(found["financial_summary"]),
    }


def scan_reduction(stg: DataFrame, kept: Column) -> DataFrame:
    """How much of a date-partitioned table a predicate on the date keeps.

    Only the partition column is read, so the counts come from file footers.
    """
    days = stg.groupBy("report_period").agg(F.count("*").alias("n"))
    totals = days.agg(
        F.sum("n").alias("total_rows"),
        F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept_rows"),
        F.count("*").alias("total_partitions"),
        F.count_if(kept).alias("kept_partitions"),
    )
    share = percent(F.col("total_rows") - F.col("kept_rows"), F.col("total_rows"))
    return totals.select("*", F.round(share, 1).alias("reduction_pct"))
