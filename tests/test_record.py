import datetime

import pytest

from wardledger.operators import cost, metrics, record

AT = "2025-09-09T09:26:37"
SAMPLES = "engine string, phase string, seconds double, cpu_percent int, memory_mb int, at timestamp_ntz"
OBJECTS = "engine string, size_bytes long, physical_bytes long, partition int"
HISTORY = (
    "engine string, job_id long, job_type string, state string, creation_time timestamp_ntz, start_time timestamp_ntz, "
    "end_time timestamp_ntz, total_slot_ms long, total_bytes_processed long, total_bytes_billed long, num_dml_affected_rows long"
)


def time(second):
    return datetime.datetime(2025, 9, 9, 9, 0, second)


@pytest.fixture
def records(spark):
    def build(samples=(), objects=(), history=()):
        return record.record(
            spark.createDataFrame(list(samples), SAMPLES), spark.createDataFrame(list(objects), OBJECTS),
            spark.createDataFrame(list(history), HISTORY), AT,
        )

    return build


def job(engine, i, **other):
    row = dict(job_type="LOAD", state="DONE", created=time(i), started=time(i), ended=time(i), slot=10, processed=5, billed=2**40, changed=7) | other
    return (engine, i, *row.values())


def test_an_engine_of_any_one_table_keeps_its_record(records):
    rows = records(
        samples=[("measured", "data_load", 1.5, 10, 100, time(1))],
        objects=[("stored", 10, 4, 1), ("stored", 20, 8, 2)],
        history=[job("worked", 1)],
    ).collect()
    found = {r.engine_name: r for r in rows}
    assert set(found) == {"measured", "stored", "worked"}
    assert found["measured"].data_load.execution_time_seconds == 1.5 and found["measured"].data_generation is None
    assert found["stored"].storage_metrics.asDict() | {} == {
        "raw_csv_bytes": 30, "raw_csv_mb": 30 / 2**20, "logical_bytes": 30, "physical_bytes": 12, "logical_mb": 30 / 2**20,
        "physical_mb": 12 / 2**20, "compression_ratio": 0.4, "num_rows": 2, "num_partitions": 2,
    }
    assert found["measured"].storage_metrics.num_rows == 0 and found["measured"].storage_metrics.compression_ratio == 0.0
    assert found["stored"].jobs == [] and len(found["worked"].jobs) == 1


def test_fields_of_the_record(records):
    row = records(
        samples=[("e", "data_generation", 2.0, 10, 100, time(3)), ("e", "data_generation", 1.0, 30, 50, time(9)), ("e", "other", 9.0, 9, 9, time(1))],
        history=[job("e", 1)],
    ).first()
    assert row.data_generation.asDict() == {
        "execution_time_seconds": 3.0, "cpu_percent_avg": 20.0, "cpu_percent_max": 30.0, "memory_mb_avg": 75.0, "memory_mb_max": 100.0,
        "memory_mb_peak": 100.0, "start_time": "2025-09-09T09:00:03", "end_time": "2025-09-09T09:00:09",
    }
    assert row.jobs[0].asDict() == {
        "place": 1, "job_id": 1, "job_type": "LOAD", "state": "DONE", "creation_time": "2025-09-09T09:00:01", "start_time": "2025-09-09T09:00:01",
        "end_time": "2025-09-09T09:00:01", "total_slot_ms": 10, "total_bytes_processed": 5, "total_bytes_billed": 2**40,
        "query_cost_usd": 5.0, "num_dml_affected_rows": 7,
    }
    assert [len(s.dataType) for s in records().schema["cost_metrics"].dataType["cost_breakdown"].dataType] == [6, 6, 6, 6, 6]


def test_small_costs_are_not_rounded(records):
    costs = records(samples=[("e", "data_load", 5.4, 1, 103, time(1))], objects=[("e", 14648, 0, 1)], history=[job("e", 1)]).first().cost_metrics
    gb = 14648 / 2**30
    assert costs.table_storage_cost_usd == gb * 0.02 * 1.0 > 0
    assert costs.cost_breakdown.cloud_storage.storage_cost_usd == gb * 0.023 * 1.0
    assert costs.total_cost_usd == (
        costs.cloud_storage_cost_usd + costs.query_cost_usd + costs.table_storage_cost_usd + costs.compute_cost_usd + costs.network_cost_usd
    )
    assert costs.cost_breakdown.network.free_egress_used_gb == gb and costs.cost_breakdown.network.billable_egress_gb == 0.0


def test_newest_jobs_and_absent_values(records):
    history = [job("e", i) for i in range(1, 8)] + [job("e", 9, created=None, started=None, ended=None, slot=None, processed=None, billed=None, changed=None)]
    row = records(history=history).first()
    assert [j.job_id for j in row.jobs] == [7, 6, 5, 4, 3]
    assert row.cost_metrics.cost_breakdown.query.bytes_processed == 35
    only = records(history=history[-1:]).first().jobs[0]
    assert (only.creation_time, only.end_time, only.total_slot_ms, only.query_cost_usd) == ("", "", 0, 0.0)


def test_json_gives_back_every_field(records):
    nested = records(
        samples=[("a", "data_load", 0.1, 3, 7, time(1)), ("b", "data_generation", 1 / 3, 3, 7, time(2))],
        objects=[("a", 123456789, 98765, 3), ("c", 1, 1, 1)],
        history=[job("a", i) for i in range(3)],
    )
    back = metrics.json_roundtrip(nested)
    assert back.schema.simpleString() == nested.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, nested.collect()))


def test_totals_beyond_bigint_stay_whole(records):
    most = 2**63 - 1
    nested = records(objects=[("e", most, most, i) for i in range(3)], history=[job("e", i, processed=most) for i in range(3)])
    back = metrics.json_roundtrip(nested)
    costs, stored = cost.narrowed(record.cost_rows(back)), cost.narrowed(record.storage_rows(back))
    assert costs.first().detail_query_bytes_processed == 3 * most
    assert (stored.first().raw_csv_bytes, stored.first().physical_bytes) == (3 * most, 3 * most)
    assert dict(costs.dtypes)["detail_query_slot_milliseconds"] == "bigint"


def test_no_engine_at_all(records):
    assert records().collect() == []
