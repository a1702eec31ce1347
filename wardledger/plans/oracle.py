"""The same queries as ANSI SQL over the driver tables, for checking results."""

from wardledger.operators import generate
from wardledger.plans.queries import ID_RANGE, MIN_EXPENSES, PROJECTION_FACTORS, YEAR

STG = """stg AS (
  SELECT CAST(100000 + o.o_custkey AS BIGINT) AS provider_id,
         cu.c_name AS hospital_name, cu.c_mktsegment AS city, n.n_name AS state,
         CAST(25 + (o.o_custkey * 7) % 300 AS INT) AS beds_number,
         make_date(CAST(year(o.o_orderdate) AS INT), 12, 31) AS report_period,
         CAST(o.o_totalprice AS DECIMAL(18,2)) AS total_expenses,
         l.total_charges,
         CAST(l.net_charges - CAST(o.o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS net_income
  FROM orders o
  JOIN customer cu ON cu.c_custkey = o.o_custkey
  JOIN nation n ON n.n_nationkey = cu.c_nationkey
  JOIN (SELECT l_orderkey,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS total_charges,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,4)) AS net_charges
        FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey)"""

RUNS = """runs AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'Query_1_Original' WHEN 1 THEN 'Query_2_Year_Filtered'
              ELSE 'Query_3_Multi_Filtered' END AS query_name,
         CASE WHEN event_id % 2 = 0 THEN 'native' ELSE 'external' END AS table_type,
         CAST(value AS DECIMAL(12,2)) AS t, event_type <> 'error' AS success
  FROM events)"""

ENGINE = "CASE user_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'external' ELSE 'spark' END"

JOBS = f"""jobs AS (
  SELECT event_id AS job_id, {ENGINE} AS engine, ts AS creation_time,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id * 1000000 END AS total_bytes_processed,
         GREATEST(event_id * 1000000, CAST(10485760 AS BIGINT)) AS total_bytes_billed,
         (event_id % 7) * 5000 AS total_slot_ms
  FROM events)"""

OBJECTS = """objects AS (
  SELECT doc_id AS object_id, n_chars * 1000000 AS size_bytes, n_chars * 2000000 AS physical_bytes,
         doc_id % 180 AS days_stored,
         CASE lang WHEN 'en' THEN 'standard_regional' WHEN 'fr' THEN 'standard_multiregional'
                   WHEN 'de' THEN 'standard_dualregional' ELSE 'archive' END AS storage_class
  FROM documents)"""

USAGE = """usage AS (
  SELECT event_id AS run_id,
         CASE event_type WHEN 'view' THEN 'e2-small' WHEN 'signup' THEN 'e2-medium'
                         WHEN 'purchase' THEN 'e2-standard' ELSE 'e2-micro' END AS machine_type,
         CAST(value AS DECIMAL(12,2)) * 5 AS vcpu_hours,
         CAST(value AS DECIMAL(12,2)) * 2 AS memory_gb_hours,
         event_id * CAST(1000000000 AS BIGINT) AS egress_bytes
  FROM events)"""

PHASES = f"""phases AS (
  SELECT event_id AS sample_id, {ENGINE} AS engine,
         CASE event_type WHEN 'view' THEN 'data_generation' WHEN 'click' THEN 'data_load'
                         ELSE 'analytics' END AS phase,
         CAST(value AS DECIMAL(12,2)) AS seconds, CAST(event_id % 101 AS INT) AS cpu_percent,
         CAST(100 + event_id % 50 AS INT) AS memory_mb
  FROM events)"""

PAYLOADS = """payloads AS (
  SELECT event_id,
         concat('[', repeat(concat(props, ','), CAST(event_id % 3 AS INT)), props, ']') AS payload
  FROM events)"""


def _with(*ctes: str, body: str) -> str:
    return f"WITH {', '.join(ctes)} {body}"


# Eleven numbers, dates and day counts of 8 bytes each, and texts with 2 bytes more than they hold.
ROW_BYTES = " + ".join(
    [f"CASE WHEN {c} IS NULL THEN 0 ELSE strlen({c}) + 2 END" for c in ("hospital_name", "city", "state")]
    + [f"CASE WHEN {c} IS NULL THEN 0 ELSE 8 END" for c in ("provider_id", "report_period", "total_expenses", "total_charges", "net_income")]
    + ["CASE WHEN beds_number IS NULL THEN 0 ELSE 8 * 6 END"]
)
PROFILE_BYTES = (
    "CASE WHEN state IS NULL THEN 0 ELSE strlen(state) + 2 END"
    + "".join(f" + CASE WHEN {c} IS NULL THEN 0 ELSE 8 END" for c in ("report_period", "beds_number", "total_expenses", "net_income"))
)


def _stg(body: str) -> str:
    return _with(STG, body=body)


def _total(column: str) -> str:
    """The exact sum of doubles: whole multiples of 2**-70, rounded once to the nearest double.

    The leading 61 or 62 bits go into one integer, with its last bit set if bits below are not
    zero, and that integer becomes the double.
    """
    units = f"SUM(CAST(CAST({column} AS DOUBLE) * pow(2.0, 70) AS HUGEINT))"
    size = f"abs({units})"
    shift = f"CAST(greatest(0, floor(log2(CAST({size} AS DOUBLE) + 1)) - 60) AS HUGEINT)"
    rest = f"CASE WHEN (({size} >> {shift}) << {shift}) <> {size} THEN CAST(1 AS HUGEINT) ELSE CAST(0 AS HUGEINT) END"
    head = f"CAST(CAST((({size} >> {shift}) | ({rest})) AS BIGINT) AS DOUBLE)"
    return f"(CASE WHEN {units} < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * {head} * pow(2.0, CAST({shift} AS INTEGER) - 70))"


def _mean(column: str) -> str:
    return f"{_total(column)} / COUNT({column})"


def _total_decimal(column: str) -> str:
    return f"CAST(SUM({column}) AS DOUBLE)"


def _d(number: float) -> str:
    return f"CAST({number!r} AS DOUBLE)"


REPORT_YEAR = "CAST(year(report_period) AS BIGINT)"


def _summary(where: str = "") -> str:
    return f"""yearly_summary AS (
  SELECT provider_id, {REPORT_YEAR} AS report_year,
         {_total('total_expenses')} AS total_expenses, {_mean('total_charges')} AS avg_charges,
         {_total('net_income')} AS total_net_income
  FROM stg WHERE beds_number > 50 {where} GROUP BY provider_id, year(report_period))"""


RANKED = """ranked AS (
  SELECT provider_id, report_year, total_expenses, avg_charges, total_net_income,
         CAST(RANK() OVER (PARTITION BY report_year ORDER BY total_net_income DESC NULLS LAST) AS BIGINT) AS income_rank,
         CAST(DENSE_RANK() OVER (PARTITION BY report_year ORDER BY total_net_income DESC NULLS LAST) AS BIGINT) AS dense_income_rank,
         LAG(total_net_income) OVER (PARTITION BY provider_id ORDER BY report_year) AS prev_net_income,
         LEAD(total_net_income) OVER (PARTITION BY provider_id ORDER BY report_year) AS next_net_income,
         total_net_income - LAG(total_net_income) OVER (PARTITION BY provider_id ORDER BY report_year) AS yoy_change
  FROM yearly_summary)"""


def _flagship(where: str = "", limit: int | None = 100) -> str:
    tail = f" ORDER BY report_year, income_rank, provider_id LIMIT {limit}" if limit else ""
    return _with(STG, _summary(where), RANKED, body=f"SELECT * FROM ranked{tail}")


def _on_ranked(body: str) -> str:
    return _with(STG, _summary(), RANKED, body=body)


YEAR_FILTER = f"AND year(report_period) = {YEAR}"
ID_FILTER = f"AND provider_id >= {ID_RANGE[0]} AND provider_id <= {ID_RANGE[1]}"

NINE = (
    "provider_id, hospital_name, city, state, beds_number, report_period, "
    "total_expenses, total_charges, net_income"
)
# All columns in the types of the fixed schema.
ALL_TYPED = (
    "provider_id, hospital_name, city, state, CAST(beds_number AS BIGINT) AS {beds}, "
    "report_period AS {period}, CAST(total_expenses AS DOUBLE) AS total_expenses, "
    "CAST(total_charges AS DOUBLE) AS total_charges, CAST(net_income AS DOUBLE) AS net_income, "
    "CAST(beds_number * 275 AS BIGINT) AS patient_days, CAST(beds_number * 30 AS BIGINT) AS discharges, "
    "CAST(beds_number * 5 AS BIGINT) AS fte_employees, CAST(beds_number * 140 AS BIGINT) AS medicare_days, "
    "CAST(beds_number * 75 AS BIGINT) AS medicaid_days"
)
NATIVE_TYPED = ALL_TYPED.format(beds="beds_number", period="report_period")
EXTERNAL_TYPED = ALL_TYPED.format(beds="beds", period="reporting_period_end")


def _bands(bounds: list[tuple[int, str]], last: str) -> str:
    whens = " ".join(f"WHEN beds_number < {bound} THEN '{label}'" for bound, label in bounds)
    return f"CASE {whens} ELSE '{last}' END"


PROFILE_BANDS = _bands(
    [(50, "Small (<50)"), (100, "Medium (50-99)"), (200, "Large (100-199)")], "Very Large (200+)"
)
CATEGORY_BANDS = _bands(
    [(100, "Small (50-99)"), (200, "Medium (100-199)"), (300, "Large (200-299)")],
    "Very Large (300+)",
)


# Rounded differences add zero, which turns -0.0 into 0.0.

# Costs, part by part. Literals are DOUBLE: a bare decimal changes the type.

def _on_demand(size: str) -> str:
    return f"(CAST(COALESCE({size}, 0) AS DOUBLE) / {_d(1024.0**4)} * {_d(5.0)})"


def _slot(ms: str) -> str:
    return f"(CAST(COALESCE({ms}, 0) AS DOUBLE) / {_d(3600000.0)} * {_d(0.04)})"


def _cheaper(size: str, ms: str) -> str:
    return (
        f"CASE WHEN {_slot(ms)} > 0 THEN LEAST({_on_demand(size)}, {_slot(ms)}) "
        f"ELSE {_on_demand(size)} END"
    )


def _gb(size: str) -> str:
    return f"(CAST({size} AS DOUBLE) / {_d(1024.0**3)})"


def _months(days: str) -> str:
    return f"(CAST({days} AS DOUBLE) / {_d(30.0)})"


def _active(size: str, days: str) -> str:
    return f"({_gb(size)} * {_d(0.02)} * {_months(days)})"


def _longterm(size: str, days: str) -> str:
    return (
        f"(CASE WHEN {days} > 90 THEN {_gb(size)} * {_d(0.01)} * {_months(f'({days} - 90)')} "
        f"ELSE {_d(0.0)} END)"
    )


UPLOAD = f"({_d(0.005)} / {_d(10000.0)})"
CLASS_RATE = (
    f"(CASE storage_class WHEN 'standard_multiregional' THEN {_d(0.026)} "
    f"WHEN 'standard_dualregional' THEN {_d(0.022)} ELSE {_d(0.023)} END)"
)


def _egress(gb: str) -> str:
    return f"GREATEST({_d(0.0)}, {gb} - {_d(1024.0)})"


OBJECT_COST = f"""object_cost AS (
  SELECT object_id, {CLASS_RATE} AS rate,
         {_gb('size_bytes')} * {CLASS_RATE} * {_months('days_stored')} AS storage,
         {UPLOAD} AS operations
  FROM objects)"""

LOAD_RUNS = """load_runs AS (
  SELECT j.job_id AS run_id, CAST(p.seconds AS DOUBLE) AS seconds, p.memory_mb,
         COALESCE(o.size_bytes, 0) AS csv_bytes, COALESCE(o.size_bytes, 0) AS logical_bytes,
         COALESCE(o.physical_bytes, 0) AS physical_bytes,
         COALESCE(j.total_bytes_processed, 0) AS processed_bytes, j.total_slot_ms AS slot_ms
  FROM jobs j JOIN phases p ON p.sample_id = j.job_id
  LEFT JOIN objects o ON o.object_id = j.job_id)"""


def _run_costs(source: str, key: str = "run_id") -> str:
    hours = f"(seconds / {_d(3600.0)})"
    base = f"({hours} * {_d(0.00478)})"
    discount = f"(CASE WHEN {hours} <= 744 THEN LEAST({base}, {base}) ELSE {_d(0.0)} END)"
    return f"""parts AS (
  SELECT {key},
         {_gb('csv_bytes')} * {_d(0.023)} * {_months('30')} + {UPLOAD} AS cloud_storage_usd,
         {_cheaper('processed_bytes', 'slot_ms')} AS query_usd,
         {_active('logical_bytes', '30')} + {_longterm('physical_bytes', '30')} AS table_storage_usd,
         GREATEST({_d(0.0)}, {base} - {discount}) AS compute_usd,
         {_egress(_gb('csv_bytes'))} * {_d(0.12)} AS network_usd
  FROM {source}),
costs AS (
  SELECT *, cloud_storage_usd + query_usd + table_storage_usd + compute_usd + network_usd AS total_usd
  FROM parts)"""


COMPONENTS = ["cloud_storage", "query", "table_storage", "compute", "network"]


ISO = "'%Y-%m-%dT%H:%M:%S'"
HISTORY = f"""history AS (
  SELECT j.*, CASE event_type WHEN 'view' THEN 'QUERY' WHEN 'click' THEN 'LOAD' ELSE 'COPY' END AS job_type,
         CASE WHEN event_type = 'error' THEN 'RUNNING' ELSE 'DONE' END AS state,
         strftime(ts, {ISO}) AS created,
         strftime(ts + to_seconds(event_id % 60), {ISO}) AS started,
         CASE WHEN event_type = 'error' THEN ''
              ELSE strftime(ts + to_seconds(event_id % 60 + (event_id % 7) * 5), {ISO}) END AS ended,
         CASE WHEN event_type = 'click' THEN event_id % 1000 ELSE 0 END AS changed
  FROM jobs j JOIN events e ON e.event_id = j.job_id)"""
MEASURED = f"""measured AS (
  SELECT p.engine, p.phase, CAST(SUM(p.seconds) AS DOUBLE) AS seconds, AVG(p.cpu_percent) AS cpu,
         CAST(MAX(p.cpu_percent) AS DOUBLE) AS cpu_max, AVG(p.memory_mb) AS memory,
         CAST(MAX(p.memory_mb) AS DOUBLE) AS memory_max,
         strftime(MIN(e.ts), {ISO}) AS first, strftime(MAX(e.ts), {ISO}) AS last
  FROM phases p JOIN events e ON e.event_id = p.sample_id
  WHERE p.phase IN ('data_generation', 'data_load') GROUP BY p.engine, p.phase)"""
STORED = """stored AS (
  SELECT CASE object_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'external' ELSE 'archive' END AS engine,
         CAST(SUM(size_bytes) AS BIGINT) AS logical, CAST(SUM(physical_bytes) AS BIGINT) AS physical,
         COUNT(*) AS num_rows, COUNT(DISTINCT days_stored) AS num_partitions
  FROM objects GROUP BY 1)"""
RECORDED = """recorded AS (
  SELECT engine, COALESCE(logical, 0) AS csv_bytes, COALESCE(logical, 0) AS logical_bytes,
         COALESCE(physical, 0) AS physical_bytes, COALESCE(num_rows, 0) AS num_rows,
         COALESCE(num_partitions, 0) AS num_partitions, COALESCE(processed, 0) AS processed_bytes,
         COALESCE(slot, 0) AS slot_ms, COALESCE(seconds, CAST(0 AS DOUBLE)) AS seconds,
         COALESCE(memory_mb, CAST(0 AS DOUBLE)) AS memory_mb
  FROM stored FULL JOIN (
    SELECT engine, CAST(SUM(COALESCE(total_bytes_processed, 0)) AS BIGINT) AS processed,
           CAST(SUM(total_slot_ms) AS BIGINT) AS slot FROM jobs GROUP BY engine) USING (engine)
  FULL JOIN (
    SELECT engine, COALESCE(MAX(CASE WHEN phase = 'data_generation' THEN seconds END), CAST(0 AS DOUBLE))
             + COALESCE(MAX(CASE WHEN phase = 'data_load' THEN seconds END), CAST(0 AS DOUBLE)) AS seconds,
           MAX(memory_max) AS memory_mb
    FROM measured GROUP BY engine) USING (engine))"""


def _mib(size: str) -> str:
    return f"CAST({size} AS DOUBLE) / {_d(1024.0**2)}"


def _record_storage() -> str:
    return _with(
        JOBS, PHASES, OBJECTS, MEASURED, STORED, RECORDED,
        body=f"SELECT engine AS engine_name, csv_bytes AS raw_csv_bytes, {_mib('csv_bytes')} AS raw_csv_mb, "
        f"logical_bytes, physical_bytes, {_mib('logical_bytes')} AS logical_mb, {_mib('physical_bytes')} AS physical_mb, "
        "CASE WHEN logical_bytes > 0 THEN CAST(physical_bytes AS DOUBLE) / CAST(logical_bytes AS DOUBLE) ELSE CAST(0 AS DOUBLE) END "
        "AS compression_ratio, num_rows, num_partitions FROM recorded",
    )


def _record_jobs() -> str:
    return _with(
        JOBS, HISTORY,
        body="SELECT engine AS engine_name, place, job_id, job_type, state, created AS creation_time, started AS start_time, "
        "ended AS end_time, total_slot_ms, COALESCE(total_bytes_processed, 0) AS total_bytes_processed, total_bytes_billed, "
        f"{_on_demand('total_bytes_billed')} AS query_cost_usd, changed AS num_dml_affected_rows "
        "FROM (SELECT *, CAST(row_number() OVER (PARTITION BY engine ORDER BY creation_time DESC, job_id DESC) AS INTEGER) AS place "
        "FROM history) WHERE place <= 5",
    )


def _record_costs() -> str:
    gb, zero = _gb("csv_bytes"), _d(0.0)
    hours = f"(seconds / {_d(3600.0)})"
    base = f"({hours} * {_d(0.00478)})"
    discount = f"(CASE WHEN {hours} <= 744 THEN LEAST({base}, {base}) ELSE {zero} END)"
    figures = {
        "cloud_storage": {
            "total_storage_cost_usd": "cloud_storage_usd", "storage_cost_usd": f"{gb} * {_d(0.023)} * {_months('30')}",
            "operations_cost_usd": UPLOAD, "size_gb": gb, "storage_class": "'standard_regional'", "rate_per_gb_month": _d(0.023),
        },
        "query": {
            "on_demand_cost_usd": _on_demand("processed_bytes"), "slot_cost_usd": _slot("slot_ms"), "recommended_cost_usd": "query_usd",
            "bytes_processed": "processed_bytes", "tb_processed": f"CAST(processed_bytes AS DOUBLE) / {_d(1024.0**4)}", "slot_milliseconds": "slot_ms",
        },
        "table_storage": {
            "total_storage_cost_usd": "table_storage_usd", "active_storage_cost_usd": _active("logical_bytes", "30"),
            "longterm_storage_cost_usd": _longterm("physical_bytes", "30"), "logical_gb": _gb("logical_bytes"),
            "physical_gb": _gb("physical_bytes"), "days_stored": "30",
        },
        "compute": {
            "total_compute_cost_usd": "compute_usd", "base_cost_usd": base, "free_tier_discount_usd": discount, "vcpu_hours": hours,
            "memory_gb_hours": f"memory_mb / {_d(1024.0)} * {hours}", "machine_type": "'e2-micro'",
        },
        "network": {
            "total_network_cost_usd": "network_usd", "egress_cost_usd": "network_usd", "ingress_cost_usd": zero, "egress_gb": gb,
            "billable_egress_gb": _egress(gb), "free_egress_used_gb": f"LEAST({gb}, {_d(1024.0)})",
        },
    }
    wide = ", ".join(f"{text} AS detail_{s}_{f}" for s, own in figures.items() for f, text in own.items())
    parts = ", ".join(f"{c}_usd AS {c}_cost_usd" for c in COMPONENTS)
    own = _run_costs("recorded", "engine, csv_bytes, logical_bytes, physical_bytes, processed_bytes, slot_ms, seconds, memory_mb")
    return _with(
        JOBS, PHASES, OBJECTS, MEASURED, STORED, RECORDED, own,
        body=f"SELECT engine AS engine_name, total_usd AS total_cost_usd, {parts}, 'us-central1' AS pricing_region, {wide} FROM costs",
    )


def _cost_share() -> str:
    sums = ", ".join(
        f"COALESCE(SUM({c}_usd), {_d(0.0)}) AS {c}" for c in COMPONENTS
    )
    total = " + ".join(COMPONENTS)
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS component, ROUND({c}, 6) AS usd, "
        f"ROUND(CASE WHEN {total} = 0 THEN NULL ELSE {c} / ({total}) END, 6) AS share FROM sums"
        for c in COMPONENTS
    )
    return _with(
        JOBS, PHASES, OBJECTS, LOAD_RUNS, _run_costs("load_runs"),
        f"sums AS (SELECT {sums} FROM costs)", body=rows,
    )


def _cost_projection() -> str:
    sized = " UNION ALL ".join(
        f"SELECT COUNT(*) * {f} AS records, CAST(SUM(size_bytes) AS DOUBLE) * {f} AS csv_bytes, "
        f"CAST(SUM(size_bytes) AS DOUBLE) * {f} AS logical_bytes, "
        f"CAST(SUM(physical_bytes) AS DOUBLE) * {f} AS physical_bytes, "
        f"CAST(SUM(size_bytes) AS DOUBLE) * {f} AS processed_bytes, "
        f"{_d(5.4)} AS seconds, 0 AS slot_ms FROM objects"
        for f in PROJECTION_FACTORS
    )
    return _with(
        OBJECTS, f"sized AS ({sized})", _run_costs("sized", "records"),
        body="SELECT CAST(records AS BIGINT) AS records, * EXCLUDE (records) FROM costs",
    )


def _results() -> list[str]:
    m = "DECIMAL(18,6)"
    per_phase = ", ".join(
        f"CAST(SUM(CASE WHEN phase = '{p}' THEN seconds END) AS {m}) AS {p}_seconds, "
        f"CAST(MAX(CASE WHEN phase = '{p}' THEN memory_mb END) AS {m}) AS {p}_memory_mb"
        for p in ("data_generation", "data_load")
    )
    mb = _d(1024.0**2)
    return [
        PHASES,
        OBJECTS,
        JOBS,
        f"per_phase AS (SELECT engine, {per_phase} FROM phases GROUP BY engine)",
        """stored AS (
  SELECT CASE object_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'external' ELSE 'spark' END AS engine,
         CAST(SUM(size_bytes) AS DOUBLE) AS logical, CAST(SUM(physical_bytes) AS DOUBLE) AS physical,
         COUNT(*) AS num_rows, COUNT(DISTINCT days_stored) AS num_partitions
  FROM objects GROUP BY 1)""",
        """job_sums AS (
  SELECT engine, CAST(SUM(COALESCE(total_bytes_processed, 0)) AS DOUBLE) AS processed_bytes,
         CAST(SUM(total_slot_ms) AS DOUBLE) AS slot_ms
  FROM jobs GROUP BY engine)""",
        """engine_runs AS (
  SELECT p.*, s.logical, s.physical, s.num_rows, s.num_partitions, j.processed_bytes, j.slot_ms,
         CAST(p.data_generation_seconds AS DOUBLE) AS seconds,
         s.logical AS csv_bytes, s.logical AS logical_bytes, s.physical AS physical_bytes
  FROM per_phase p JOIN stored s ON s.engine = p.engine JOIN job_sums j ON j.engine = p.engine)""",
        _run_costs("engine_runs", "engine"),
        f"""results AS (
  SELECT r.engine, '2024-01-01T00:00:00' AS timestamp,
         data_generation_seconds, data_generation_memory_mb, data_load_seconds, data_load_memory_mb,
         CAST(ROUND(logical / {mb}, 6) AS {m}) AS raw_csv_mb,
         CAST(ROUND(logical / {mb}, 6) AS {m}) AS logical_mb,
         CAST(ROUND(physical / {mb}, 6) AS {m}) AS physical_mb,
         CAST(ROUND(physical / logical, 6) AS {m}) AS compression_ratio,
         num_rows, num_partitions,
         CAST(ROUND(total_usd, 6) AS {m}) AS total_usd,
         {', '.join(f'CAST(ROUND({c}_usd, 6) AS {m}) AS {c}_usd' for c in COMPONENTS)},
         'us-central1' AS pricing_region, '2024-01-01T00:00:00' AS pricing_timestamp
  FROM engine_runs r JOIN costs c ON c.engine = r.engine)""",
    ]


def _long_form() -> str:
    entries = [
        ("performance", "data_generation", "execution_time_seconds", "data_generation_seconds", "seconds"),
        ("performance", "data_generation", "memory_mb_peak", "data_generation_memory_mb", "MB"),
        ("performance", "data_load", "execution_time_seconds", "data_load_seconds", "seconds"),
        ("performance", "data_load", "memory_mb_peak", "data_load_memory_mb", "MB"),
        ("storage", "table_metrics", "CSV", "raw_csv_mb", "MB"),
        ("storage", "table_metrics", "Warehouse_Logical", "logical_mb", "MB"),
        ("storage", "table_metrics", "Warehouse_Physical", "physical_mb", "MB"),
        ("storage", "table_metrics", "Compression_Ratio", "compression_ratio", "ratio"),
        ("storage", "table_metrics", "Row_Count", "num_rows", "count"),
        ("storage", "table_metrics", "Partition_Count", "num_partitions", "count"),
        ("cost", "cost_breakdown", "Total_Pipeline_Cost", "total_usd", "USD"),
        ("cost", "cost_breakdown", "Cloud_Storage_Cost", "cloud_storage_usd", "USD"),
        ("cost", "cost_breakdown", "Warehouse_Processing_Cost", "query_usd", "USD"),
        ("cost", "cost_breakdown", "Warehouse_Storage_Cost", "table_storage_usd", "USD"),
        ("cost", "cost_breakdown", "Compute_Processing_Cost", "compute_usd", "USD"),
        ("cost", "cost_breakdown", "Network_Cost", "network_usd", "USD"),
        ("metadata", "pricing", "pricing_region", "pricing_region", "region"),
        ("metadata", "pricing", "pricing_timestamp", "pricing_timestamp", "timestamp"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT engine, timestamp, '{kind}' AS metric_type, '{category}' AS metric_category, "
        f"'{name}' AS metric_name, CAST({column} AS VARCHAR) AS metric_value, '{unit}' AS unit "
        "FROM results"
        for kind, category, name, column, unit in entries
    )
    return _with(*_results(), body=rows)


def _synthetic() -> str:
    def draw(n: int) -> str:
        digits = f"substr(digest, {n * 8 + 1}, 8)"
        return f"((CAST(CAST('0x' || {digits} AS BIGINT) AS DOUBLE) + {_d(0.5)}) / {_d(16.0**8)})"

    def between(n: int, bounds: tuple[float, float]) -> str:
        return f"({_d(bounds[0])} + {draw(n)} * {_d(bounds[1] - bounds[0])})"

    def normal(a: int, b: int, turn: str) -> str:
        return f"(sqrt({_d(-2.0)} * ln({draw(a)})) * {turn}({_d(2 * 3.141592653589793)} * {draw(b)}))"

    def pick(n: int, values: list) -> str:
        listed = ", ".join(
            "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values
        )
        return f"([{listed}])[CAST(floor({draw(n)} * {_d(float(len(values)))}) AS INT) + 1]"

    days = ", ".join(
        f"{between(11 + i, b)} AS {name}" for i, (name, b) in enumerate(generate.PER_BED.items())
    )
    counts = ", ".join(
        f"CAST(floor(beds_number * {name}) AS BIGINT) AS {name}" for name in generate.PER_BED
    )
    beds = f"floor(exp({_d(4.5)} + {_d(0.8)} * {normal(4, 5, 'cos')}))"
    return f"""WITH digests AS (
  SELECT c_custkey AS id, sha256('a|' || c_custkey || '|42') || sha256('b|' || c_custkey || '|42') AS digest
  FROM customer),
drawn AS (
  SELECT id + 100000 AS provider_id, {pick(0, generate.CITIES)} AS city,
         {pick(1, generate.STATES)} AS state, {pick(2, generate.HOSPITAL_NAMES)} AS kind,
         {pick(3, generate.YEARS)} AS year,
         CAST(GREATEST(25, LEAST({beds}, 1200)) AS BIGINT) AS beds_number,
         {_d(500000.0)} + {_d(100000.0)} * {normal(4, 5, 'sin')} AS per_bed,
         {_d(1.0)} + {_d(0.3)} * {normal(6, 7, 'cos')} AS factor,
         {between(8, (2.5, 5.5))} AS charge_rate, {between(9, (0.3, 0.7))} AS revenue_rate,
         {between(10, (0.05, 0.15))} AS other_rate, {days}
  FROM digests),
money AS (
  SELECT *, GREATEST({_d(1000000.0)}, beds_number * per_bed * factor) AS expenses FROM drawn)
SELECT provider_id, city || ' ' || kind AS hospital_name, city, state, beds_number,
       make_date(year, 12, 31) AS report_period,
       ROUND(expenses, 2) AS total_expenses, ROUND(expenses * charge_rate, 2) AS total_charges,
       ROUND(expenses * charge_rate * revenue_rate + expenses * other_rate - expenses, 2) AS net_income,
       {counts}
FROM money"""


def oracle() -> dict[str, str]:
    flagship_q1 = _flagship()
    flagship_q2 = _flagship(YEAR_FILTER)
    flagship_q3 = _flagship(f"{YEAR_FILTER} {ID_FILTER}")
    flagship_full = _flagship(limit=None)
    summary = _with(STG, _summary(), body="SELECT * FROM yearly_summary")
    loaded = _stg(f"SELECT {NATIVE_TYPED} FROM stg")
    long_form = _long_form()
    quartiles = _on_ranked(
        "SELECT quartile, COUNT(*) AS providers, MIN(total_net_income) AS min_net_income, "
        "MAX(total_net_income) AS max_net_income, "
        f"{_total('total_net_income')} / COUNT(*) AS avg_net_income "
        "FROM (SELECT total_net_income, CAST(NTILE(4) OVER (ORDER BY total_net_income, provider_id) "
        "AS BIGINT) AS quartile FROM ranked) GROUP BY quartile"
    )
    load_costs = [JOBS, PHASES, OBJECTS, LOAD_RUNS, _run_costs("load_runs")]
    return {
        "flagship_q1": flagship_q1,
        "flagship_q2": flagship_q2,
        "flagship_q3": flagship_q3,
        "flagship_full": flagship_full,
        "flagship_full_by_value": flagship_full,
        "sql_entry_q1": flagship_q1,
        "external_q1": flagship_q1,
        "external_q2": flagship_q2,
        "external_q3": flagship_q3,
        "yearly_summary": summary,
        "cast_date_year": summary,
        "analytics_table": flagship_full,
        "analytics_top10": _flagship(limit=10),
        "top5_per_year": _on_ranked(
            "SELECT provider_id, report_year, total_net_income, income_rank, total_expenses "
            "FROM ranked WHERE income_rank <= 5"
        ),
        "yoy_growth_counts": _on_ranked(
            "SELECT report_year, COUNT(CASE WHEN yoy_change > 0 THEN 1 END) AS growing, "
            "COUNT(CASE WHEN yoy_change < 0 THEN 1 END) AS declining, "
            "COUNT(CASE WHEN yoy_change = 0 THEN 1 END) AS flat, "
            "COUNT(CASE WHEN yoy_change IS NULL THEN 1 END) AS no_prior FROM ranked GROUP BY report_year"
        ),
        "rank_distribution": _on_ranked(
            "SELECT income_rank, COUNT(*) AS providers FROM ranked GROUP BY income_rank"
        ),
        "income_quartiles": quartiles,
        "income_quartiles_by_value": quartiles,
        "total_records": _stg("SELECT COUNT(*) AS count FROM stg"),
        "count_over_50_beds": _stg("SELECT COUNT(*) AS count FROM stg WHERE beds_number > 50"),
        "year_distribution": _stg(
            f"SELECT {REPORT_YEAR} AS year, COUNT(*) AS hospitals, AVG(beds_number) AS avg_beds, "
            f"{_total('total_expenses')} AS total_expenses, {_mean('total_expenses')} AS avg_expenses "
            "FROM stg GROUP BY 1 ORDER BY 1"
        ),
        "state_distribution": _stg(
            "SELECT state, COUNT(*) AS hospitals, AVG(beds_number) AS avg_beds, "
            f"{_mean('total_expenses')} AS avg_expenses FROM stg GROUP BY state "
            "ORDER BY hospitals DESC, state LIMIT 10"
        ),
        "bed_size_categories": _stg(
            f"SELECT {PROFILE_BANDS} AS size_category, COUNT(*) AS hospitals, "
            f"{_mean('total_expenses')} AS avg_expenses, {_mean('net_income')} AS avg_net_income "
            "FROM stg GROUP BY 1"
        ),
        "financial_summary": _stg(
            "SELECT CAST(MIN(total_expenses) AS DOUBLE) AS min_expenses, "
            "CAST(MAX(total_expenses) AS DOUBLE) AS max_expenses, "
            f"{_mean('total_expenses')} AS avg_expenses, "
            "ROUND(STDDEV_SAMP(CAST(total_expenses AS DOUBLE)), 2) AS stddev_expenses, "
            "CAST(MIN(net_income) AS DOUBLE) AS min_net_income, "
            "CAST(MAX(net_income) AS DOUBLE) AS max_net_income, "
            f"{_mean('net_income')} AS avg_net_income, "
            "COUNT(CASE WHEN net_income < 0 THEN 1 END) AS loss_making_hospitals FROM stg"
        ),
        "profile_stats": _stg(
            "SELECT CAST(MIN(beds_number) AS BIGINT) AS min_beds, "
            "CAST(MAX(beds_number) AS BIGINT) AS max_beds, AVG(beds_number) AS avg_beds, "
            "CAST(MIN(total_expenses) AS DOUBLE) AS min_expenses, "
            "CAST(MAX(total_expenses) AS DOUBLE) AS max_expenses, "
            f"{_mean('total_expenses')} AS avg_expenses, "
            "COUNT(CASE WHEN beds_number > 50 THEN 1 END) AS over_50_beds FROM stg"
        ),
        "preview_ordered": _stg(
            "SELECT provider_id, hospital_name, city, state, CAST(beds_number AS BIGINT) AS beds_number, "
            "report_period, CAST(total_expenses AS DOUBLE) AS total_expenses "
            "FROM stg ORDER BY report_period, provider_id, total_expenses LIMIT 5"
        ),
        "top_expense_hospitals": _stg(
            f"SELECT provider_id, hospital_name, city, state, CAST(beds_number AS BIGINT) AS beds_number, {REPORT_YEAR} AS report_year, "
            "CAST(total_expenses AS DOUBLE) AS total_expenses, CAST(total_charges AS DOUBLE) AS total_charges, "
            "CAST(net_income AS DOUBLE) AS net_income, "
            "ROUND(CAST(total_charges AS DOUBLE) / NULLIF(CAST(total_expenses AS DOUBLE), 0), 2) "
            "AS charge_to_expense_ratio FROM stg WHERE beds_number > 50 "
            "ORDER BY total_expenses DESC, provider_id, report_year, total_charges, net_income LIMIT 20"
        ),
        "top_expense_preview": _stg(
            f"SELECT provider_id, hospital_name, CAST(beds_number AS BIGINT) AS beds_number, {REPORT_YEAR} AS report_year, "
            "CAST(total_expenses AS DOUBLE) AS total_expenses FROM stg WHERE beds_number > 50 "
            "ORDER BY total_expenses DESC, provider_id, report_year LIMIT 10"
        ),
        "yearly_comparison_filtered": _stg(
            f"SELECT {REPORT_YEAR} AS report_year, COUNT(*) AS hospital_count, AVG(beds_number) AS avg_beds, "
            f"{_total('total_expenses')} AS total_expenses, {_mean('total_expenses')} AS avg_expenses, "
            f"{_total('net_income')} AS total_net_income, {_mean('net_income')} AS avg_net_income "
            "FROM stg WHERE beds_number > 50 GROUP BY 1"
        ),
        "state_analysis": _stg(
            "SELECT state, COUNT(*) AS hospital_count, AVG(beds_number) AS avg_beds, "
            f"{_mean('total_expenses')} AS avg_expenses, {_mean('net_income')} AS avg_net_income, "
            "ROUND(AVG(CAST(total_charges AS DOUBLE) / NULLIF(CAST(total_expenses AS DOUBLE), 0)), 2) "
            "AS avg_charge_ratio FROM stg WHERE beds_number > 50 GROUP BY state HAVING COUNT(*) >= 2"
        ),
        "size_category_filtered": _stg(
            f"SELECT {CATEGORY_BANDS} AS size_category, COUNT(*) AS hospital_count, "
            f"{_mean('total_expenses')} AS avg_expenses, {_mean('net_income')} AS avg_net_income, "
            "CAST(MIN(net_income) AS DOUBLE) AS min_net_income, "
            "CAST(MAX(net_income) AS DOUBLE) AS max_net_income FROM stg WHERE beds_number > 50 GROUP BY 1"
        ),
        "profit_margin": _stg(
            f"SELECT provider_id, hospital_name, {REPORT_YEAR} AS report_year, CAST(beds_number AS BIGINT) AS beds_number, "
            "CAST(total_expenses AS DOUBLE) AS total_expenses, CAST(net_income AS DOUBLE) AS net_income, "
            "ROUND(CAST(net_income AS DOUBLE) / NULLIF(CAST(total_expenses AS DOUBLE), 0) * 100, 2) "
            f"AS profit_margin_pct FROM stg WHERE beds_number > 100 AND total_expenses > {MIN_EXPENSES} "
            "AND net_income IS NOT NULL ORDER BY profit_margin_pct DESC, total_expenses DESC, "
            "provider_id, report_year, net_income LIMIT 50"
        ),
        "stg_binding": _stg(
            f"SELECT {NINE}, beds_number * 275 AS patient_days, beds_number * 30 AS discharges, "
            "beds_number * 5 AS fte_employees, beds_number * 140 AS medicare_days, "
            "beds_number * 75 AS medicaid_days FROM stg"
        ),
        "csv_roundtrip": loaded,
        "csv_load": loaded,
        "staging_roundtrip": loaded,
        "load_overwrite": loaded,
        "record_performance": _with(
            PHASES, MEASURED,
            body="SELECT engine AS engine_name, phase, seconds AS execution_time_seconds, cpu AS cpu_percent_avg, "
            "cpu_max AS cpu_percent_max, memory AS memory_mb_avg, memory_max AS memory_mb_max, memory_max AS memory_mb_peak, "
            "first AS start_time, last AS end_time FROM measured",
        ),
        "record_storage": _record_storage(),
        "record_jobs": _record_jobs(),
        "record_costs": _record_costs(),
        "versioned_load": loaded,
        "load_append": _stg(
            f"SELECT {NATIVE_TYPED} FROM stg UNION ALL SELECT {NATIVE_TYPED} FROM stg"
        ),
        "table_recreate": loaded,
        "external_renamed_scan": _stg(f"SELECT {EXTERNAL_TYPED} FROM stg"),
        "external_multi_file_scan": _stg(
            " UNION ALL ".join([f"SELECT {EXTERNAL_TYPED} FROM stg"] * 8)
        ),
        "external_copies_summary": _with(
            STG,
            _summary(),
            body="SELECT provider_id, report_year, total_expenses * 8 AS total_expenses, avg_charges, "
            "total_net_income * 8 AS total_net_income FROM yearly_summary",
        ),
        "latest_batch": _stg(
            "SELECT 'hospital_cost_sample_' || n || 'rows_' || strftime(loaded_at, '%Y%m%d_%H%M%S') "
            "AS batch_name, date_trunc('second', loaded_at) AS batch_ts, n AS rows "
            "FROM (SELECT report_period, COUNT(*) AS n FROM stg GROUP BY report_period) b "
            "JOIN (SELECT make_date(CAST(year(o_orderdate) AS INT), 12, 31) AS period, "
            "MAX(o_orderdate) AS loaded_at FROM orders GROUP BY 1) o ON o.period = b.report_period "
            "ORDER BY loaded_at DESC LIMIT 1"
        ),
        "partition_counts": _stg(
            "SELECT report_period, COUNT(*) AS records FROM stg GROUP BY report_period"
        ),
        "scan_reduction": _stg(
            "SELECT total_rows, kept_rows, total_partitions, kept_partitions, "
            "ROUND((total_rows - kept_rows) / total_rows * 100, 1) AS reduction_pct FROM ("
            f"SELECT COUNT(*) AS total_rows, COUNT(CASE WHEN year(report_period) = {YEAR} THEN 1 END) AS kept_rows, "
            "COUNT(DISTINCT report_period) AS total_partitions, "
            f"COUNT(DISTINCT CASE WHEN year(report_period) = {YEAR} THEN report_period END) AS kept_partitions "
            "FROM stg)"
        ),
        "dq_report": _stg(
            'SELECT "check", failed_rows, failed_rows = 0 AS passed FROM ('
            "SELECT 'required_columns' AS \"check\", CAST(0 AS BIGINT) AS failed_rows UNION ALL "
            "SELECT 'unique_provider_id', COUNT(*) - COUNT(DISTINCT provider_id) FROM stg UNION ALL "
            "SELECT 'positive_beds', COUNT(CASE WHEN beds_number <= 0 THEN 1 END) FROM stg UNION ALL "
            "SELECT 'expenses_present', COUNT(CASE WHEN total_expenses IS NULL THEN 1 END) FROM stg)"
        ),
        "required_violations": _stg(
            "SELECT required_column, null_rows FROM (SELECT unnest(["
            + ", ".join(
                f"{{'required_column': '{c}', 'null_rows': COUNT(*) - COUNT(s.{c})}}"
                for c in (
                    "provider_id", "report_period", "total_expenses", "total_charges",
                    "net_income", "beds_number",
                )
            )
            + "], recursive := true) FROM customer c LEFT JOIN stg s ON s.provider_id = c.c_custkey + 100000)"
        ),
        "load_reconciliation": _stg(
            "SELECT COUNT(*) AS source_rows, "
            "SUM(CASE WHEN p % 7 = 0 THEN 0 WHEN p % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS target_rows, "
            "SUM(CASE WHEN p % 7 = 0 OR p % 11 = 0 THEN 1 ELSE 0 END)::BIGINT AS missing, "
            "SUM(CASE WHEN p % 7 = 0 THEN 0 WHEN p % 11 = 0 AND p % 5 = 0 THEN 2 "
            "WHEN p % 11 = 0 OR p % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS extra "
            "FROM (SELECT provider_id AS p FROM stg)"
        ),
        "storage_metrics": _stg(
            "SELECT report_period, COUNT(*) AS rows, TRUE AS all_sized, TRUE AS paths_distinct "
            "FROM stg GROUP BY report_period"
        ),
        "table_storage": _stg(
            "SELECT COUNT(*) AS num_rows, COUNT(DISTINCT report_period) AS num_partitions, "
            f"SUM({ROW_BYTES})::BIGINT AS logical_bytes, SUM({ROW_BYTES})::BIGINT / 1048576.0::DOUBLE AS logical_mb, "
            "TRUE AS files_in_each_partition, TRUE AS sized, TRUE AS ratio_of_both FROM stg"
        ),
        "load_measures": _stg(
            "SELECT COUNT(*) AS rows, COUNT(DISTINCT report_period) AS periods, "
            f"SUM({ROW_BYTES})::BIGINT AS logical_bytes, SUM({PROFILE_BYTES})::BIGINT AS scanned_bytes, "
            "SUM((provider_id IS NULL)::INT + (report_period IS NULL)::INT + (total_expenses IS NULL)::INT "
            "+ (total_charges IS NULL)::INT + (net_income IS NULL)::INT + (beds_number IS NULL)::INT)::BIGINT "
            "AS null_values FROM stg"
        ),
        "scan_reduction_measured": _stg(
            "SELECT total_rows, kept_rows, total_rows AS total_rows_read, kept_rows AS kept_rows_read, total_partitions, "
            "kept_partitions, TRUE AS fewer_files, TRUE AS fewer_bytes, TRUE AS bytes_saved FROM ("
            f"SELECT COUNT(*) AS total_rows, COUNT(CASE WHEN year(report_period) = {YEAR} THEN 1 END) AS kept_rows, "
            "COUNT(DISTINCT report_period) AS total_partitions, "
            f"COUNT(DISTINCT CASE WHEN year(report_period) = {YEAR} THEN report_period END) AS kept_partitions "
            "FROM stg)"
        ),
        "load_reconciliation_cells": _stg(
            "SELECT COUNT(*) AS source_rows, "
            "SUM(CASE WHEN hit AND p % 7 = 0 THEN 0 WHEN hit AND p % 5 = 0 THEN 2 ELSE 1 END)::BIGINT AS target_rows, "
            "SUM(CASE WHEN hit AND (p % 7 = 0 OR p % 11 = 0) THEN 1 ELSE 0 END)::BIGINT AS missing, "
            "SUM(CASE WHEN NOT hit OR p % 7 = 0 THEN 0 WHEN p % 11 = 0 AND p % 5 = 0 THEN 2 "
            "WHEN p % 11 = 0 OR p % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS extra, "
            "COUNT(DISTINCT (report_period, id_range)) AS cells, "
            "COUNT(DISTINCT CASE WHEN hit AND (p % 7 = 0 OR p % 11 = 0 OR p % 5 = 0) THEN (report_period, id_range) END) "
            "AS cells_differing FROM (SELECT *, id_range % 10 = 3 AND year(report_period) = "
            f"{YEAR} AS hit FROM (SELECT report_period, provider_id AS p, provider_id // 64 AS id_range FROM stg))"
        ),
        "yearly_summary_sample": _with(
            STG, _summary(),
            body="SELECT LEAST(10, COUNT(*)) AS rows, LEAST(10, COUNT(*)) AS rows_in_summary FROM yearly_summary",
        ),
        "synthetic_hospitals": _synthetic(),
        "hospital_display_name": _stg(
            "SELECT provider_id, report_period, concat_ws(' ', city, hospital_name) AS display_name FROM stg"
        ),
        "clamped_beds": _stg(
            "SELECT provider_id, CAST(beds_number AS BIGINT) AS beds_number, CAST(GREATEST(40, LEAST(beds_number, 250)) AS BIGINT) "
            "AS clamped_beds FROM stg"
        ),
        "unit_conversion": _with(
            OBJECTS,
            body="SELECT object_id, "
            + ", ".join(
                f"CAST(size_bytes AS DOUBLE) / {_d(1024.0**power)} AS size_{unit}"
                for power, unit in enumerate(("kb", "mb", "gb", "tb"), start=1)
            )
            + " FROM objects",
        ),
        "formatted_year_report": _stg(
            f"SELECT {REPORT_YEAR} AS year, format('{{:,}}', COUNT(*)) AS hospitals, "
            "format('{:.0f}', AVG(beds_number)) AS avg_beds, "
            f"'$' || format('{{:,.0f}}', {_total('total_expenses')}) AS total_expenses, "
            f"'$' || format('{{:,.0f}}', {_mean('total_expenses')}) AS avg_expenses FROM stg GROUP BY 1"
        ),
        "batch_name": (
            "SELECT event_id, 'hospital_cost_sample_' || user_id || 'rows_' || "
            "strftime(ts, '%Y%m%d_%H%M%S') AS batch_name FROM events"
        ),
        "json_row_count": _with(
            PAYLOADS,
            body="SELECT event_id, CAST(json_array_length(payload) AS BIGINT) AS n FROM payloads",
        ),
        "query_cost": _with(
            JOBS,
            body=f"SELECT job_id, {_on_demand('total_bytes_processed')} AS on_demand, "
            f"{_slot('total_slot_ms')} AS slot, "
            f"{_cheaper('total_bytes_processed', 'total_slot_ms')} AS recommended FROM jobs",
        ),
        "job_billed_cost": _with(
            JOBS, body=f"SELECT job_id, {_on_demand('total_bytes_billed')} AS cost FROM jobs"
        ),
        "job_totals": _with(
            JOBS,
            body="SELECT COUNT(*) AS jobs, CAST(SUM(COALESCE(total_bytes_processed, 0)) AS BIGINT) "
            "AS bytes_processed, CAST(SUM(total_slot_ms) AS BIGINT) AS slot_ms, "
            f"{_on_demand('SUM(total_bytes_billed)')} AS cost FROM jobs",
        ),
        "warehouse_storage_cost": _with(
            OBJECTS,
            body="SELECT object_id, active, longterm, active + longterm AS total FROM ("
            f"SELECT object_id, {_active('size_bytes', 'days_stored')} AS active, "
            f"{_longterm('physical_bytes', 'days_stored')} AS longterm FROM objects)",
        ),
        "storage_cost": _with(
            OBJECTS, OBJECT_COST, body="SELECT *, storage + operations AS total FROM object_cost"
        ),
        "storage_cost_joined": _with(
            OBJECTS,
            OBJECT_COST,
            body="SELECT d.doc_id AS object_id, d.n_chars * 1000000 AS size_bytes, "
            "c.storage + c.operations AS total FROM documents d "
            "LEFT JOIN object_cost c ON c.object_id = d.doc_id",
        ),
        "compute_cost": _with(
            USAGE,
            f"""priced AS (
  SELECT run_id, machine_type, vcpu_hours, CAST(vcpu_hours AS DOUBLE) * {_d(0.00478)} AS micro,
         CASE machine_type WHEN 'e2-micro' THEN CAST(vcpu_hours AS DOUBLE) * {_d(0.00478)}
                           WHEN 'e2-small' THEN CAST(vcpu_hours AS DOUBLE) * {_d(0.02)}
                           WHEN 'e2-medium' THEN CAST(vcpu_hours AS DOUBLE) * {_d(0.03)}
                           ELSE CAST(vcpu_hours AS DOUBLE) * {_d(0.03)}
                                + CAST(memory_gb_hours AS DOUBLE) * {_d(0.004)} END AS base
  FROM usage),
discounted AS (
  SELECT *, CASE WHEN machine_type = 'e2-micro' AND vcpu_hours <= 744 THEN LEAST(base, micro)
                 ELSE {_d(0.0)} END AS discount FROM priced)""",
            body=f"SELECT run_id, base, discount, GREATEST({_d(0.0)}, base - discount) AS total FROM discounted",
        ),
        "network_cost": _with(
            USAGE,
            f"sized AS (SELECT run_id, {_gb('egress_bytes')} AS egress_gb FROM usage)",
            body=f"SELECT run_id, egress_gb, {_egress('egress_gb')} AS billable_gb, "
            f"LEAST(egress_gb, {_d(1024.0)}) AS free_gb, {_egress('egress_gb')} * {_d(0.12)} AS cost FROM sized",
        ),
        "end_to_end_cost": _with(*load_costs, body="SELECT * FROM costs"),
        "cost_share": _cost_share(),
        "cost_projection": _cost_projection(),
        "benchmark_summary": _with(
            RUNS,
            """means AS (
  SELECT query_name,
         CAST(SUM(CASE WHEN table_type = 'native' THEN t END) AS DOUBLE)
           / COUNT(CASE WHEN table_type = 'native' THEN t END) AS native,
         CAST(SUM(CASE WHEN table_type = 'external' THEN t END) AS DOUBLE)
           / COUNT(CASE WHEN table_type = 'external' THEN t END) AS external
  FROM runs WHERE success GROUP BY query_name),
diffs AS (SELECT *, ROUND((external - native) / native * 100, 1) + CAST(0 AS DOUBLE) AS diff FROM means
          WHERE native IS NOT NULL AND external IS NOT NULL)""",
            body="SELECT query_name, ROUND(native, 3) AS native_avg_time, "
            "ROUND(external, 3) AS external_avg_time, diff AS performance_difference_pct, "
            "external > native AS external_slower, "
            "CASE WHEN diff > 10 THEN 'red' WHEN diff > 0 THEN 'amber' ELSE 'green' END AS status FROM diffs",
        ),
        "benchmark_overall": _with(
            RUNS,
            """means AS (
  SELECT CAST(SUM(CASE WHEN table_type = 'native' THEN t END) AS DOUBLE)
           / COUNT(CASE WHEN table_type = 'native' THEN t END) AS native_avg,
         CAST(SUM(CASE WHEN table_type = 'external' THEN t END) AS DOUBLE)
           / COUNT(CASE WHEN table_type = 'external' THEN t END) AS external_avg,
         COUNT(CASE WHEN table_type = 'native' THEN 1 END) AS native_ok,
         COUNT(CASE WHEN table_type = 'external' THEN 1 END) AS external_ok
  FROM runs WHERE success)""",
            body="SELECT native_avg, external_avg, "
            "ROUND((external_avg - native_avg) / native_avg * 100, 1) + CAST(0 AS DOUBLE) AS overall_diff_pct, "
            "native_ok, external_ok FROM means",
        ),
        "engine_comparison": _with(
            PHASES,
            body="SELECT engine, "
            + ", ".join(
                f"CAST(COALESCE(SUM(CASE WHEN phase = '{p}' THEN seconds END), 0) AS DOUBLE) AS {p}"
                for p in ("data_generation", "data_load", "analytics")
            )
            + ", CAST(COALESCE(SUM(CASE WHEN phase IN ('data_generation', 'data_load', 'analytics') "
            "THEN NULL ELSE seconds END), 0) AS DOUBLE) AS other"
            + f", {_total_decimal('seconds')} AS total FROM phases GROUP BY engine",
        ),
        "engine_cost_comparison": _with(
            JOBS,
            body=f"SELECT engine, {_on_demand('SUM(total_bytes_billed)')} AS cost FROM jobs GROUP BY engine",
        ),
        "phase_rollup": _with(
            PHASES,
            body=f"SELECT engine, {_total_decimal('seconds')} AS total_seconds, "
            "CAST(MAX(memory_mb) AS BIGINT) AS peak_memory FROM phases GROUP BY engine",
        ),
        "resource_samples_summary": _with(
            PHASES,
            body="SELECT phase, AVG(cpu_percent) AS cpu_avg, CAST(MAX(cpu_percent) AS BIGINT) AS cpu_max, "
            "AVG(memory_mb) AS mem_avg, CAST(MAX(memory_mb) AS BIGINT) AS mem_max FROM phases GROUP BY phase",
        ),
        "storage_ratio": _with(
            OBJECTS,
            body=f"SELECT object_id, CAST(size_bytes AS DOUBLE) / {_d(1024.0**2)} AS logical_mb, "
            f"CAST(physical_bytes AS DOUBLE) / {_d(1024.0**2)} AS physical_mb, "
            "CASE WHEN size_bytes > 0 THEN CAST(physical_bytes AS DOUBLE) / CAST(size_bytes AS DOUBLE) "
            "ELSE CAST(0 AS DOUBLE) END AS ratio FROM objects",
        ),
        "metrics_long_form": long_form,
        "metrics_json_roundtrip": long_form,
        "recent_jobs": _with(
            JOBS,
            body="SELECT engine, CAST(place AS INT) AS place, job_id, total_slot_ms, total_bytes_processed, "
            "total_bytes_billed FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY engine "
            "ORDER BY creation_time DESC, job_id DESC) AS place FROM jobs) WHERE place <= 5",
        ),
    }
