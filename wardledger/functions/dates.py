"""Report periods, years and batch timestamps."""

import datetime

from pyspark.sql import Column, functions as F

BATCH_STAMP = "yyyyMMdd_HHmmss"


def report_year(period: Column) -> Column:
    return F.year(period).cast("bigint")


def year_equals(period: Column, year: int) -> Column:
    """``year(period) = year`` as a range on the bare column.

    The range prunes date partitions and is pushed down to a file scan of an
    unpartitioned table; a comparison on ``year(period)`` reaches neither a
    Parquet row group nor the CSV parser.
    """
    return (period >= F.lit(datetime.date(year, 1, 1))) & (
        period < F.lit(datetime.date(year + 1, 1, 1))
    )


def year_end(timestamp: Column) -> Column:
    return F.make_date(F.year(timestamp), F.lit(12), F.lit(31))


def batch_stamp(timestamp: Column) -> Column:
    return F.date_format(timestamp, BATCH_STAMP)


def batch_name(rows: Column, timestamp: Column) -> Column:
    """Name of a landing batch: row count and load time."""
    return F.concat(
        F.lit("hospital_cost_sample_"),
        rows.cast("string"),
        F.lit("rows_"),
        batch_stamp(timestamp),
    )
