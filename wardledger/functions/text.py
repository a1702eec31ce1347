"""Display names, number formats and JSON lengths."""

from pyspark.sql import Column, functions as F


def display_name(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def thousands(value: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(value, 0)


def dollars(value: Column) -> Column:
    return F.concat(F.lit("$"), thousands(value))


def whole(value: Column) -> Column:
    """Whole number without separators."""
    return F.format_string("%d", F.bround(value, 0).cast("bigint"))


def json_rows(payload: Column) -> Column:
    """Rows in a JSON array result; 0 for an absent or empty result."""
    return F.coalesce(F.json_array_length(payload), F.lit(0)).cast("bigint")
