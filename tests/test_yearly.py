import random

import pytest

from tests.conftest import rows
from wardledger.operators import ranking, yearly
from wardledger.operators.yearly import FLAGSHIP_COLUMNS, flagship


def by_key(df):
    return {(r.provider_id, r.report_year): r for r in df.collect()}


def test_ties_leave_a_gap_in_rank_only(reports):
    stg = reports(
        [(1, 2023, 60, 10.0, 5.0), (2, 2023, 60, 10.0, 5.0), (3, 2023, 60, 10.0, 1.0)]
    )
    found = by_key(flagship(stg))
    assert [found[p, 2023].income_rank for p in (1, 2, 3)] == [1, 1, 3]
    assert [found[p, 2023].dense_income_rank for p in (1, 2, 3)] == [1, 1, 2]


def test_lag_uses_the_previous_year_present(reports):
    stg = reports([(1, 2021, 60, 10.0, 4.0), (1, 2023, 60, 10.0, 9.0)])
    found = by_key(flagship(stg))
    assert found[1, 2023].prev_net_income == 4.0
    assert found[1, 2023].yoy_change == 5.0
    assert found[1, 2021].next_net_income == 9.0
    assert found[1, 2021].prev_net_income is None


def test_single_year_has_no_neighbours(reports):
    row = flagship(reports([(1, 2023, 60, 10.0, 4.0)])).first()
    assert (row.prev_net_income, row.next_net_income, row.yoy_change) == (None, None, None)


def test_reports_of_a_year_add_up_and_nulls_are_skipped(reports):
    stg = reports([(1, 2023, 60, 10.0, None), (1, 2023, 60, 20.0, 3.0), (1, 2023, 60, None, 2.0)])
    row = flagship(stg).first()
    assert row.total_expenses == 30.0
    assert row.avg_charges == 45.0
    assert row.total_net_income == 5.0


def test_filters_apply_before_the_windows(reports):
    stg = reports([(1, 2022, 60, 10.0, 4.0), (1, 2023, 60, 10.0, 9.0), (2, 2023, 50, 1.0, 1.0)])
    found = rows(flagship(stg, year=2023).select("provider_id", "prev_net_income", "income_rank"))
    assert found == [(1, None, 1)]


def test_id_range_is_inclusive(reports):
    stg = reports([(p, 2023, 60, 10.0, float(p)) for p in range(1, 6)])
    found = flagship(stg, id_range=(2, 4)).select("provider_id")
    assert rows(found) == [(4,), (3,), (2,)]


def test_empty_input_keeps_the_columns(reports):
    empty = flagship(reports([(1, 2023, 10, 1.0, 1.0)]))
    assert empty.columns == FLAGSHIP_COLUMNS
    assert empty.collect() == []
    assert flagship(reports([(1, 2023, 10, 1.0, 1.0)]), limit=None).collect() == []


@pytest.fixture
def many(reports):
    """Random provider-years with many ties, NULLs, and both signs."""
    rng = random.Random(7)
    values = [rng.choice([0.0, None, rng.uniform(-5e8, 5e8), rng.uniform(-300, 300)])
              for _ in range(600)]
    values = [v if v is None else round(v, 2) for v in values]
    return reports(
        [(p, 2020 + p % 3 + y, 60, 10.0, values[(p * 4 + y) % 600])
         for p in range(300) for y in range(3)]
    )


def brute_ranks(found):
    expected = {}
    for row in found:
        year = [r.total_net_income for r in found if r.report_year == row.report_year]
        mine = row.total_net_income
        above = [v for v in year if v is not None and (mine is None or v > mine)]
        expected[row.provider_id, row.report_year] = (len(above) + 1, len(set(above)) + 1)
    return expected


def test_limited_report_has_the_ranks_of_the_full_one(many):
    full = by_key(flagship(many, limit=None))
    ordered = sorted(full.values(), key=lambda r: (r.report_year, r.income_rank, r.provider_id))
    for limit in (1, 50, 400, 2_000_000):
        assert [tuple(r) for r in flagship(many, limit=limit).collect()] == [
            tuple(r) for r in ordered[:limit]
        ]


def test_ranks_by_value_match_brute_force(many):
    summary = yearly.with_neighbour_years(yearly.yearly_summary(many))
    found = ranking.rank_incomes(summary).collect()
    assert len(found) == summary.count()
    expected = brute_ranks(found)
    for row in found:
        assert (row.income_rank, row.dense_income_rank) == expected[row.provider_id, row.report_year]


@pytest.mark.parametrize("first, fanout", [(0.5, 2.0), (7.0, 5.0), (1e12, 3.0)])
def test_ranks_do_not_depend_on_the_buckets(many, monkeypatch, first, fanout):
    """Narrow buckets send ties, signs and NULLs through every level."""
    monkeypatch.setattr(ranking, "FIRST_BUCKET", first)
    monkeypatch.setattr(ranking, "FANOUT", fanout)
    found = ranking.rank_incomes(yearly.yearly_summary(many)).collect()
    expected = brute_ranks(found)
    assert len(found) == 900
    for row in found:
        assert (row.income_rank, row.dense_income_rank) == expected[row.provider_id, row.report_year]


def test_ranks_agree_with_windows_and_no_window_holds_a_year(many):
    summary = yearly.with_neighbour_years(yearly.yearly_summary(many))
    ranked = ranking.rank_incomes(summary)
    by_window = sorted(map(str, ranking.rank_incomes_in_one_task(summary).select(*ranked.columns).collect()))
    assert by_window == sorted(map(str, ranked.collect()))
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan and "bucket" in plan


@pytest.fixture
def small_partitions(spark):
    """Let adaptive execution treat tens of kilobytes as a large partition."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_many_equal_incomes_are_split_over_tasks(spark, small_partitions):
    """A third of all provider-years with one income is a hot key of the join back."""
    income = yearly.F.when(yearly.F.col("id") % 3 == 0, 0.0).otherwise(
        yearly.F.col("id").cast("double"))
    summary = spark.range(0, 200_000, 1, 8).select(
        yearly.F.col("id").alias("provider_id"),
        yearly.F.lit(2023).cast("bigint").alias("report_year"),
        income.alias("total_net_income"),
    )
    ranked = ranking.rank_incomes(summary)
    assert len(ranked.collect()) == 200_000
    assert "skew=true" in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.filter("income_rank = 133334").count() == 66_667


def test_buckets_bound_the_windows(many):
    values = ranking.value_positions(
        yearly.yearly_summary(many), ranking.F.col("report_year"), "total_net_income"
    )
    # Distinct keys in one bucket of 100 never exceed its 4-decimal amounts.
    bucket = ranking.F.floor(ranking.F.col("key") / 100)
    most = values.groupBy("grp", bucket.alias("b")).count().agg({"count": "max"}).first()[0]
    assert most <= 1_000_000
    assert values.count() == values.select("grp", "key").distinct().count()


@pytest.mark.parametrize("tiles", [1, 3, 4, 7])
def test_quartiles_agree_with_ntile(many, tiles):
    ranked = flagship(many, limit=None)
    small = sorted(map(tuple, ranking.income_quartiles(ranked, tiles).collect()))
    incomes = sorted(r.total_net_income for r in ranked.collect() if r.total_net_income is not None)
    base, extra = divmod(len(incomes), tiles)
    start = 0
    for tile, providers, low, high, mean in small:
        size = base + (tile <= extra)
        part = incomes[start:start + size]
        assert (providers, low, high) == (size, part[0], part[-1])
        assert mean == pytest.approx(sum(part) / size)
        start += size


def test_sql_text_equals_the_dataframe(many):
    text = yearly.flagship_sql(many, "many_reports")
    assert rows(text) == rows(flagship(many))


def test_growth_and_distribution(reports):
    stg = reports(
        [
            (1, 2022, 60, 1.0, 1.0), (1, 2023, 60, 1.0, 2.0),
            (2, 2022, 60, 1.0, 5.0), (2, 2023, 60, 1.0, 3.0),
            (3, 2022, 60, 1.0, 4.0), (3, 2023, 60, 1.0, 4.0),
        ]
    )
    ranked = flagship(stg, limit=None)
    growth = sorted(rows(yearly.growth_counts(ranked)))
    assert growth == [(2022, 0, 0, 0, 3), (2023, 1, 1, 1, 0)]
    assert sorted(rows(yearly.rank_distribution(ranked))) == [(1, 2), (2, 2), (3, 2)]
    top = sorted(rows(yearly.top_k_per_year(ranked, 1).select("provider_id", "report_year")))
    assert top == [(2, 2022), (3, 2023)]
