import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from wardledger.operators import cost
from wardledger.plans.queries import _job_totals

GB = 1024**3
TB = 1024**4


def load_run(spark, **changes):
    run = {
        "run_id": 1,
        "seconds": 5.4,
        "memory_mb": 103.0,
        "csv_bytes": 11890,
        "logical_bytes": 12363,
        "physical_bytes": 26447,
        "processed_bytes": 0,
        "slot_ms": 0,
    } | changes
    return spark.createDataFrame([run], "run_id long, seconds double, memory_mb double, csv_bytes long, "
                                 "logical_bytes long, physical_bytes long, processed_bytes long, slot_ms long")


def test_published_costs_of_a_hundred_rows(spark):
    row = cost.end_to_end_cost(load_run(spark)).first()
    assert row.cloud_storage_usd == 7.546887844800948e-07
    assert row.table_storage_usd == 2.3027881979942324e-07
    assert row.total_usd == 9.84967604279518e-07
    assert (row.query_usd, row.compute_usd, row.network_usd) == (0.0, 0.0, 0.0)


def test_nested_record(spark):
    record = cost.cost_record(cost.end_to_end_cost(load_run(spark))).first()
    assert record.cost_metrics.total_usd == 9.84967604279518e-07
    assert record.cost_metrics.cost_breakdown.table_storage_usd == 2.3027881979942324e-07
    assert record.cost_metrics.pricing_region == "us-central1"


def test_rate_card(spark):
    card = cost.rate_card(spark)
    assert card.count() == 19
    assert card.schema["usd"].dataType.typeName() == "double"
    assert rows(card.filter("item = 'on_demand'").select("usd")) == [(5.0,)]
    assert card.select("service", "item").distinct().count() == 19


def test_query_cost_takes_slots_only_when_used(spark):
    jobs = spark.createDataFrame(
        [(1, TB, 0), (2, TB, 3_600_000), (3, None, 3_600_000), (4, 1, 3_600_000)],
        "job_id long, total_bytes_processed long, total_slot_ms long",
    )
    found = {r.job_id: (r.on_demand, r.slot, r.recommended) for r in cost.query_cost(jobs).collect()}
    assert found[1] == (5.0, 0.0, 5.0)
    assert found[2] == (5.0, 0.04, 0.04)
    assert found[3] == (0.0, 0.04, 0.0)
    assert found[4][2] == found[4][0]


def test_storage_past_ninety_days(spark):
    objects = spark.createDataFrame(
        [(1, GB, 2 * GB, 90), (2, GB, 2 * GB, 91)],
        "object_id long, size_bytes long, physical_bytes long, days_stored long",
    )
    found = {r.object_id: r for r in cost.warehouse_storage_cost(objects).collect()}
    assert found[1].longterm == 0.0
    assert found[1].active == pytest.approx(0.06)
    assert found[2].longterm == pytest.approx(2 * 0.01 / 30)
    assert found[2].active == pytest.approx(0.02 * 91 / 30)


def test_unknown_storage_class_pays_the_regional_rate(spark):
    objects = spark.createDataFrame(
        [(1, GB, 30, "standard_multiregional"), (2, GB, 30, "archive"), (3, GB, 30, None)],
        "object_id long, size_bytes long, days_stored long, storage_class string",
    )
    found = {r.object_id: (r.rate, r.total) for r in cost.storage_cost(objects).collect()}
    assert found[1] == (0.026, pytest.approx(0.026 + 5e-7))
    assert found[2] == found[3] == (0.023, pytest.approx(0.023 + 5e-7))


def test_micro_machine_is_free_up_to_744_hours(spark):
    usage = spark.createDataFrame(
        [(1, "e2-micro", 744.0, 1.0), (2, "e2-micro", 744.01, 1.0), (3, "e2-small", 10.0, 9.0),
         (4, "e2-medium", 10.0, 9.0), (5, "n1", 10.0, 5.0)],
        "run_id long, machine_type string, vcpu_hours double, memory_gb_hours double",
    )
    found = {r.run_id: r.total for r in cost.compute_cost(usage).collect()}
    assert found[1] == 0.0
    assert found[2] == pytest.approx(744.01 * 0.00478)
    assert found[3] == pytest.approx(0.2)
    assert found[4] == pytest.approx(0.3)
    assert found[5] == pytest.approx(0.3 + 0.02)


def test_first_terabyte_of_egress_is_free(spark):
    usage = spark.createDataFrame([(1, 1024 * GB), (2, 1025 * GB)], "run_id long, egress_bytes long")
    found = {r.run_id: (r.billable_gb, r.free_gb, r.cost) for r in cost.network_cost(usage).collect()}
    assert found == {1: (0.0, 1024.0, 0.0), 2: (1.0, 1024.0, 0.12)}


def test_totals_survive_sums_past_the_long_range_of_products(spark):
    jobs = spark.createDataFrame(
        [(i, None if i == 0 else TB, TB, 5) for i in range(4)],
        "job_id long, total_bytes_processed long, total_bytes_billed long, total_slot_ms long",
    )
    row = cost.job_totals(jobs).first()
    assert tuple(row) == (4, 3 * TB, 20, 20.0)
    empty = cost.job_totals(jobs.limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)
    assert rows(cost.job_billed_cost(jobs.limit(1)).select("cost")) == [(5.0,)]


def test_totals_beyond_bigint_stay_whole(spark):
    most = 2**63 - 1
    jobs = spark.createDataFrame(
        [(i, most, most, 5) for i in range(3)],
        "job_id long, total_bytes_processed long, total_bytes_billed long, total_slot_ms long",
    )
    found = _job_totals(jobs)
    assert tuple(found.first())[:3] == (3, 3 * most, 15)
    assert [t for _, t in found.dtypes] == ["bigint", "decimal(30,0)", "bigint", "double"]
    assert [t for _, t in _job_totals(jobs.limit(1)).dtypes] == ["bigint", "bigint", "bigint", "double"]
    assert tuple(_job_totals(jobs.limit(0)).first()) == (0, 0, 0, 0.0)


def test_shares_add_up(spark):
    runs = load_run(spark, csv_bytes=2000 * GB).unionByName(load_run(spark, processed_bytes=TB))
    found = {r.component: (r.usd, r.share) for r in cost.cost_share(cost.end_to_end_cost(runs)).collect()}
    assert list(found) == cost.COMPONENTS
    assert sum(share for _, share in found.values()) == pytest.approx(1.0, abs=1e-5)
    assert found["query"][0] == 5.0
    assert found["network"][0] == pytest.approx((2000 - 1024) * 0.12)


def test_share_of_nothing_is_null(spark):
    costs = cost.end_to_end_cost(load_run(spark)).limit(0)
    assert {r.share for r in cost.cost_share(costs).collect()} == {None}


def test_projection_grows_with_the_factor(spark):
    measured = load_run(spark).withColumnRenamed("run_id", "records").withColumn(
        "records", F.lit(100).cast("long"))
    found = {r.records: r for r in cost.cost_projection(measured, [1, 1000]).collect()}
    assert found[100].total_usd == 9.84967604279518e-07
    assert found[100_000].table_storage_usd == pytest.approx(1000 * 2.3027881979942324e-07)


def test_sizes_attach_to_costs(spark):
    files = spark.createDataFrame([(1, 10), (2, 20)], "object_id long, size_bytes long")
    costs = spark.createDataFrame([(1, 0.5)], "object_id long, total double")
    assert sorted(rows(cost.storage_cost_joined(files, costs))) == [(1, 10, 0.5), (2, 20, None)]


def test_shares_of_a_run_of_the_smallest_size(spark):
    names = [f"{name}_usd" for name in cost.COMPONENTS]
    usd = {n: 0.0 for n in names} | {"cloud_storage_usd": 7.546887844800948e-07, "table_storage_usd": 2.3027881979942324e-07}
    costs = spark.createDataFrame([tuple(usd.values())], ", ".join(f"{n} double" for n in usd))
    shares = {r.component: r.share for r in cost.cost_share(costs).collect()}
    assert (shares["cloud_storage"], shares["table_storage"]) == (0.766207, 0.233793)
