"""Schemas of the hospital cost-report tables.

Files are always read with one of these schemas, never with inference.
"""

from pyspark.sql import types as T

# The fourteen columns of the staging table, in file order.
NATIVE_COLUMNS = [
    ("provider_id", T.LongType()),
    ("hospital_name", T.StringType()),
    ("city", T.StringType()),
    ("state", T.StringType()),
    ("beds_number", T.LongType()),
    ("report_period", T.DateType()),
    ("total_expenses", T.DoubleType()),
    ("total_charges", T.DoubleType()),
    ("net_income", T.DoubleType()),
    ("patient_days", T.LongType()),
    ("discharges", T.LongType()),
    ("fte_employees", T.LongType()),
    ("medicare_days", T.LongType()),
    ("medicaid_days", T.LongType()),
]

# The two columns the external table calls by another name.
EXTERNAL_NAMES = {"beds_number": "beds", "report_period": "reporting_period_end"}
NATIVE_NAMES = {external: native for native, external in EXTERNAL_NAMES.items()}

# Columns a cost-report table cannot do without.
REQUIRED_COLUMNS = [
    "provider_id",
    "report_period",
    "total_expenses",
    "total_charges",
    "net_income",
    "beds_number",
]

NATIVE_SCHEMA = T.StructType([T.StructField(n, t) for n, t in NATIVE_COLUMNS])
EXTERNAL_SCHEMA = T.StructType(
    [T.StructField(EXTERNAL_NAMES.get(n, n), t) for n, t in NATIVE_COLUMNS]
)

PARTITION_COLUMN = "report_period"
CLUSTER_COLUMN = "provider_id"
