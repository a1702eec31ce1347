import datetime
import random

import pytest

from tests.conftest import rows
from wardledger.functions.sizes import CATEGORY_BANDS, PROFILE_BANDS
from wardledger.operators import profile
from pyspark.sql import functions as F

BEDS = [49, 50, 51, 99, 100, 199, 200, 299, 300, None]


def test_profile_bands(reports):
    stg = reports([(i, 2023, beds, 1.0, 1.0) for i, beds in enumerate(BEDS)])
    found = rows(profile.bed_size_categories(stg).select("size_category", "hospitals"))
    assert found == [
        ("Small (<50)", 1),
        ("Medium (50-99)", 3),
        ("Large (100-199)", 2),
        ("Very Large (200+)", 4),
    ]


def test_category_bands_drop_fifty_and_null(reports):
    stg = reports([(i, 2023, beds, 1.0, 1.0) for i, beds in enumerate(BEDS)])
    found = rows(profile.size_categories_filtered(stg).select("size_category", "hospital_count"))
    assert found == [
        ("Small (50-99)", 2),
        ("Medium (100-199)", 2),
        ("Large (200-299)", 2),
        ("Very Large (300+)", 1),
    ]


def test_band_positions(spark):
    for bands in (PROFILE_BANDS, CATEGORY_BANDS):
        labels = [label for _, label in bands.bounds] + [bands.last]
        df = spark.createDataFrame([(label,) for label in labels], "label string")
        assert rows(df.select(bands.position(F.col("label")))) == [(1,), (2,), (3,), (4,)]


def test_having_keeps_states_with_two_rows(reports):
    stg = reports(
        [(1, 2023, 60, 10.0, 1.0, "NY"), (2, 2023, 60, 20.0, 1.0, "CA"), (3, 2023, 60, 40.0, 2.0, "CA")]
    )
    found = profile.state_analysis(stg).collect()
    assert [(r.state, r.hospital_count, r.avg_expenses, r.avg_charge_ratio) for r in found] == [
        ("CA", 2, 30.0, 3.0)
    ]


def test_zero_expenses_give_a_null_ratio(reports):
    stg = reports([(1, 2023, 60, 0.0, 1.0), (2, 2023, 60, 10.0, 1.0)])
    found = {r.provider_id: r.charge_to_expense_ratio for r in profile.top_expense_hospitals(stg).collect()}
    assert found == {1: None, 2: 3.0}


def test_financial_summary_of_one_and_no_row(reports):
    one = profile.financial_summary(reports([(1, 2023, 60, 10.0, -1.0)])).first()
    assert one.stddev_expenses is None
    assert one.loss_making_hospitals == 1
    none = profile.financial_summary(reports([(1, 2023, 60, 1.0, 1.0)]).limit(0)).first()
    assert (none.min_expenses, none.avg_expenses, none.loss_making_hospitals) == (None, None, 0)


def test_stddev_is_the_sample_one(reports):
    row = profile.financial_summary(
        reports([(i, 2023, 60, v, 1.0) for i, v in enumerate((2.0, 4.0, 9.0))])
    ).first()
    assert row.stddev_expenses == 3.61


def test_state_distribution_breaks_ties_by_state(reports):
    states = [chr(ord("A") + i) * 2 for i in range(12)]
    stg = reports([(i, 2023, 60, 1.0, 1.0, s) for i, s in enumerate(reversed(states))])
    assert [r.state for r in profile.by_state(stg).collect()] == states[:10]


def test_profit_margin_filters_and_order(reports):
    stg = reports(
        [
            (1, 2023, 101, 60e6, 6e6),
            (2, 2023, 101, 70e6, 7e6),
            (3, 2023, 100, 70e6, 9e6),
            (4, 2023, 101, 50e6, 9e6),
            (5, 2023, 101, 60e6, None),
        ]
    )
    found = rows(profile.profit_margin(stg).select("provider_id", "profit_margin_pct"))
    assert found == [(2, 10.0), (1, 10.0)]


def test_counts_and_preview(reports):
    stg = reports([(2, 2022, 50, 1.0, 1.0), (1, 2022, 51, 1.0, 1.0), (3, 2021, 60, 1.0, 1.0)])
    assert rows(profile.row_count(stg)) == [(3,)]
    assert rows(profile.row_count(stg, F.col("beds_number") > 50)) == [(2,)]
    assert [r.provider_id for r in profile.preview(stg, 2).collect()] == [3, 1]
    assert profile.row_count(stg.limit(0)).first()[0] == 0


def test_scan_reduction(reports):
    stg = reports([(i, year, 60, 1.0, 1.0) for i, year in enumerate((2021, 2021, 2022, 2023))])
    kept = F.col("report_period") == F.lit(datetime.date(2021, 12, 31))
    assert rows(profile.scan_reduction(stg, kept)) == [(4, 2, 3, 1, 50.0)]


@pytest.mark.parametrize("size", [0, 1, 700])
def test_one_scan_equals_five(reports, size):
    rng = random.Random(size)
    states = ["NY", "CA", "TX", None]
    stg = reports(
        [
            (
                i,
                rng.choice([2021, 2022, 2023]),
                rng.choice(BEDS),
                rng.choice([None, 0.0, round(rng.uniform(1, 1e8), 2)]),
                rng.choice([None, round(rng.uniform(-1e7, 1e7), 2)]),
                rng.choice(states),
            )
            for i in range(size)
        ]
    )
    report = profile.staging_profile(stg)
    alone = {
        "total_records": profile.row_count(stg),
        "year_distribution": profile.by_year(stg),
        "state_distribution": profile.by_state(stg),
        "bed_size_categories": profile.bed_size_categories(stg),
        "financial_summary": profile.financial_summary(stg),
    }
    assert list(report) == list(alone)
    for name, expected in alone.items():
        assert report[name].columns == expected.columns
        assert rows(report[name]) == rows(expected), name


def test_numeric_profile(reports):
    row = profile.numeric_profile(reports([(1, 2023, 60, 10.0, 1.0), (2, 2023, 40, 30.0, 1.0)])).first()
    assert (row.min_beds, row.max_beds, row.avg_beds, row.avg_expenses, row.over_50_beds) == (
        40, 60, 50.0, 20.0, 1,
    )


@pytest.mark.parametrize("value", [0.1 + 0.2, 1e8 / 3])
def test_sums_do_not_depend_on_order(spark, reports, value):
    items = [(1, 2023, 60, round(value * (i % 7), 2), 1.0) for i in range(500)]
    there = profile.by_year(reports(items).repartition(7)).first().total_expenses
    back = profile.by_year(reports(items[::-1]).repartition(3)).first().total_expenses
    assert there == back
