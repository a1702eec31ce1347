from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.operators.generate import CITIES, HOSPITAL_NAMES, STATES, generate, synthetic_hospitals
from wardledger.operators.quality import quality_report
from wardledger.schema import NATIVE_SCHEMA


def test_schema_and_size(spark):
    df = synthetic_hospitals(spark, 50)
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in NATIVE_SCHEMA]
    assert df.count() == 50
    assert synthetic_hospitals(spark, 0).count() == 0


def test_ranges(spark):
    df = synthetic_hospitals(spark, 5000)
    charge = F.col("total_charges") / F.col("total_expenses")
    days = {"patient_days": (200, 350), "discharges": (15, 45), "fte_employees": (3, 8),
            "medicare_days": (80, 200), "medicaid_days": (30, 120)}
    bad = (
        ~F.col("beds_number").between(25, 1200)
        | (F.col("total_expenses") < 1e6)
        | ~charge.between(2.499999, 5.500001)
        | ~F.col("city").isin(CITIES)
        | ~F.col("state").isin(STATES)
        | ~F.year("report_period").between(2021, 2024)
        | (F.month("report_period") != 12)
    )
    for name, (low, high) in days.items():
        bad = bad | (F.col(name) < F.floor(F.col("beds_number") * low)) | (F.col(name) > F.col("beds_number") * high)
    assert df.filter(bad).count() == 0
    kinds = df.select(F.expr("substring(hospital_name, length(city) + 2)").alias("k")).distinct()
    assert {r.k for r in kinds.collect()} == set(HOSPITAL_NAMES)
    assert all(r.passed for r in quality_report(df).collect())


def test_distribution(spark):
    row = synthetic_hospitals(spark, 20000).agg(
        F.expr("percentile(beds_number, 0.5)").alias("median"),
        F.avg(F.col("total_expenses") / F.col("beds_number")).alias("per_bed"),
        F.countDistinct("report_period").alias("years"),
        F.count_if(F.col("net_income") < 0).alias("losses"),
    ).first()
    assert 85 < row.median < 95
    assert 480_000 < row.per_bed < 520_000
    assert row.years == 4
    assert 0 < row.losses < 20000


def test_rows_depend_on_index_and_seed_only(spark):
    one = sorted(rows(generate(spark.range(300).repartition(7))))
    other = sorted(rows(generate(spark.range(300).coalesce(1))))
    assert one == other
    assert one != sorted(rows(synthetic_hospitals(spark, 300, seed=1)))
