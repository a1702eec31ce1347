"""Bed-size bands, clamping and byte units."""

from typing import NamedTuple

from pyspark.sql import Column, functions as F, types as T


class Bands(NamedTuple):
    """Upper bounds with their labels, in order; ``last`` takes the rest."""

    bounds: list[tuple[int, str]]
    last: str

    def label(self, value: Column) -> Column:
        """Band of a value; NULL falls into the last band."""
        labelled = None
        for bound, name in self.bounds:
            when = F.when if labelled is None else labelled.when
            labelled = when(value < bound, F.lit(name))
        return labelled.otherwise(F.lit(self.last))

    def position(self, label: Column) -> Column:
        """Place of a label in the order of the bands, from 1."""
        order = F.lit(len(self.bounds) + 1)
        for place, (_, name) in reversed(list(enumerate(self.bounds, start=1))):
            order = F.when(label == name, F.lit(place)).otherwise(order)
        return order


# Bands of the staging profile.
PROFILE_BANDS = Bands(
    [(50, "Small (<50)"), (100, "Medium (50-99)"), (200, "Large (100-199)")],
    "Very Large (200+)",
)

# Bands of the size-category query.
CATEGORY_BANDS = Bands(
    [(100, "Small (50-99)"), (200, "Medium (100-199)"), (300, "Large (200-299)")],
    "Very Large (300+)",
)

KIB, MIB, GIB, TIB = (1024.0**power for power in (1, 2, 3, 4))


# Bytes a value counts with; a text counts its UTF-8 bytes and two more.
BYTES_OF_TYPE = {
    T.BooleanType: 1,
    T.ByteType: 8,
    T.ShortType: 8,
    T.IntegerType: 8,
    T.LongType: 8,
    T.FloatType: 8,
    T.DoubleType: 8,
    T.DateType: 8,
    T.TimestampType: 8,
    T.TimestampNTZType: 8,
    T.DecimalType: 16,
}
TEXT_OVERHEAD = 2


def logical_bytes(schema: T.StructType, columns: list[str] | None = None) -> Column:
    """Size of a row before compression, by the types of its columns; NULL takes nothing."""
    size = F.lit(0).cast("bigint")
    for field in schema:
        if columns is not None and field.name not in columns:
            continue
        value = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            taken = F.octet_length(value).cast("bigint") + F.lit(TEXT_OVERHEAD)
        elif isinstance(field.dataType, T.BinaryType):
            taken = F.octet_length(value).cast("bigint")
        elif type(field.dataType) in BYTES_OF_TYPE:
            taken = F.when(value.isNotNull(), F.lit(BYTES_OF_TYPE[type(field.dataType)]))
        else:
            raise TypeError(f"no logical size is defined for {field.dataType.simpleString()} ({field.name})")
        size = size + F.coalesce(taken, F.lit(0)).cast("bigint")
    return size


def in_unit(size_bytes: Column, unit: float) -> Column:
    return size_bytes.cast("double") / F.lit(unit)


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))
