"""Synthetic hospital cost reports.

Every number is a function of (row index, seed): the same rows come out for
any partitioning, and a recomputed task repeats itself.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardledger.functions.sizes import clamp
from wardledger.functions.text import display_name

# The word lists of the sample data.
HOSPITAL_NAMES = [
    "General", "Medical Center", "Regional", "Community", "Memorial",
    "University", "St. Mary's", "Methodist", "Baptist", "Presbyterian",
]
CITIES = [
    "New York", "Los Angeles", "Chicago", "Houston", "Phoenix", "Philadelphia",
    "San Antonio", "San Diego", "Dallas", "San Jose", "Austin", "Jacksonville",
    "Fort Worth", "Columbus", "Charlotte", "San Francisco", "Indianapolis",
    "Seattle", "Denver", "Boston", "Nashville", "Baltimore", "Louisville",
]
STATES = [
    "NY", "CA", "IL", "TX", "AZ", "PA", "FL", "OH", "NC", "WA",
    "CO", "MA", "TN", "MD", "KY", "GA", "MI", "VA", "NJ", "CT",
]
YEARS = [2021, 2022, 2023, 2024]

# First provider number and the distributions of the sample data.
FIRST_PROVIDER = 100000
LOG_BEDS = (4.5, 0.8)
BEDS_RANGE = (25, 1200)
COST_PER_BED = (500000.0, 100000.0)
COST_FACTOR = (1.0, 0.3)
LEAST_EXPENSES = 1000000.0
CHARGES_PER_EXPENSE = (2.5, 5.5)
REVENUE_PER_CHARGE = (0.3, 0.7)
OTHER_PER_EXPENSE = (0.05, 0.15)
PER_BED = {
    "patient_days": (200.0, 350.0),
    "discharges": (15.0, 45.0),
    "fte_employees": (3.0, 8.0),
    "medicare_days": (80.0, 200.0),
    "medicaid_days": (30.0, 120.0),
}

_DIGITS = 8  # hexadecimal digits per draw: 32 bits


def _draw(number: int) -> Column:
    """Uniform number in (0, 1) from the row's digest."""
    digits = F.substring("digest", number * _DIGITS + 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(16.0**_DIGITS)


def _between(number: int, bounds: tuple[float, float]) -> Column:
    low, high = bounds
    return F.lit(low) + _draw(number) * F.lit(high - low)


def _normal(first: int, second: int, turn) -> Column:
    """Standard normal number by the Box-Muller transform."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(_draw(first)))
    return radius * turn(F.lit(2 * math.pi) * _draw(second))


def _pick(number: int, values: list) -> Column:
    place = F.floor(_draw(number) * F.lit(float(len(values)))).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in values]), place + 1)


def generate(indexes: DataFrame, seed: int = 42) -> DataFrame:
    """One cost report per row of ``indexes``, which has a column ``id``."""
    seeded = F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))
    digest = F.concat(
        F.sha2(F.concat(F.lit("a|"), seeded), 256), F.sha2(F.concat(F.lit("b|"), seeded), 256)
    )
    log_mean, log_spread = LOG_BEDS
    beds = F.floor(F.exp(F.lit(log_mean) + F.lit(log_spread) * _normal(4, 5, F.cos)))
    drawn = indexes.select("id", digest.alias("digest")).select(
        (F.col("id") + FIRST_PROVIDER).alias("provider_id"),
        _pick(0, CITIES).alias("city"),
        _pick(1, STATES).alias("state"),
        _pick(2, HOSPITAL_NAMES).alias("kind"),
        _pick(3, YEARS).alias("year"),
        clamp(beds, *BEDS_RANGE).cast("bigint").alias("beds_number"),
        (F.lit(COST_PER_BED[0]) + F.lit(COST_PER_BED[1]) * _normal(4, 5, F.sin)).alias("per_bed"),
        (F.lit(COST_FACTOR[0]) + F.lit(COST_FACTOR[1]) * _normal(6, 7, F.cos)).alias("factor"),
        _between(8, CHARGES_PER_EXPENSE).alias("charge_rate"),
        _between(9, REVENUE_PER_CHARGE).alias("revenue_rate"),
        _between(10, OTHER_PER_EXPENSE).alias("other_rate"),
        *[_between(11 + i, bounds).alias(name) for i, (name, bounds) in enumerate(PER_BED.items())],
    )
    expenses = F.greatest(
        F.lit(LEAST_EXPENSES), F.col("beds_number") * F.col("per_bed") * F.col("factor")
    )
    charges = F.col("expenses") * F.col("charge_rate")
    income = charges * F.col("revenue_rate") + F.col("expenses") * F.col("other_rate")
    return drawn.withColumn("expenses", expenses).select(
        "provider_id",
        display_name(F.col("city"), F.col("kind")).alias("hospital_name"),
        "city",
        "state",
        "beds_number",
        F.make_date("year", F.lit(12), F.lit(31)).alias("report_period"),
        F.round("expenses", 2).alias("total_expenses"),
        F.round(charges, 2).alias("total_charges"),
        F.round(income - F.col("expenses"), 2).alias("net_income"),
        *[F.floor(F.col("beds_number") * F.col(name)).alias(name) for name in PER_BED],
    )


def synthetic_hospitals(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    return generate(spark.range(rows), seed)
