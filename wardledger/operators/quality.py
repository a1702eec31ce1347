"""Checks before and after a load."""

from pyspark.sql import Column, DataFrame, functions as F

from wardledger.schema import CLUSTER_COLUMN, PARTITION_COLUMN, REQUIRED_COLUMNS
from wardledger.session import materialise


def enforce_required(df: DataFrame, column: str = "provider_id") -> DataFrame:
    """Fail the running job on the first NULL in a required column.

    File sources ignore ``nullable=False``. The check rides along with the
    write, so it costs no second scan, and a failed task stops the commit.
    """
    present = F.coalesce(
        F.col(column), F.raise_error(F.lit(f"required column {column} is NULL"))
    )
    return df.withColumn(column, present)


def required_violations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NULLs per required column, counted in one pass."""
    columns = columns or REQUIRED_COLUMNS
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], columns, "required_column", "null_rows")


def quality_report(df: DataFrame, key: str = "provider_id") -> DataFrame:
    """Required columns, unique key, positive beds and present expenses.

    One scan: rows collapse to one per key first, partially before the
    shuffle, and the checks add up over the keys.
    """
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        checks = [("required_columns", F.lit(len(missing)).cast("bigint"))]
        totals = df.sparkSession.range(1)
    else:
        per_key = df.groupBy(key).agg(
            F.count("*").alias("n"),
            F.count_if(F.col("beds_number") <= 0).alias("bad_beds"),
            F.count_if(F.col("total_expenses").isNull()).alias("no_expenses"),
        )
        totals = per_key.agg(
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
            F.coalesce(F.sum("bad_beds"), F.lit(0)).alias("bad_beds"),
            F.coalesce(F.sum("no_expenses"), F.lit(0)).alias("no_expenses"),
        )
        checks = [
            ("required_columns", F.lit(0).cast("bigint")),
            ("unique_provider_id", F.col("surplus")),
            ("positive_beds", F.col("bad_beds")),
            ("expenses_present", F.col("no_expenses")),
        ]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), failed.alias("failed_rows"))
            for name, failed in checks
        ]
    )
    return totals.select(F.inline(rows)).select(
        "check", "failed_rows", (F.col("failed_rows") == 0).alias("passed")
    )


def load_reconciliation(source: DataFrame, target: DataFrame) -> DataFrame:
    """Row counts of both sides, and rows missing from or extra in the target.

    Copies count. Both sides are read once and meet in one aggregation that
    is partial before the shuffle, so any number of copies is cheap.
    """
    columns = source.columns
    aligned = target.select(*[F.col(f.name).cast(f.dataType) for f in source.schema.fields])
    both = source.select("*", F.lit(1).alias("ours"), F.lit(0).alias("theirs")).unionByName(
        aligned.select("*", F.lit(0).alias("ours"), F.lit(1).alias("theirs"))
    )
    per_row = both.groupBy(*columns).agg(
        F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs")
    )
    surplus = F.col("ours") - F.col("theirs")
    none = F.lit(0).cast("bigint")
    return per_row.agg(
        F.coalesce(F.sum("ours"), none).alias("source_rows"),
        F.coalesce(F.sum("theirs"), none).alias("target_rows"),
        F.coalesce(F.sum(F.greatest(surplus, none)), none).alias("missing"),
        F.coalesce(F.sum(F.greatest(-surplus, none)), none).alias("extra"),
    )


# A 64-bit hash is summed in pieces of 22 bits, so that BIGINT holds the sums of 2**41 rows.
PIECE_BITS = 22
PIECES = range(0, 64, PIECE_BITS)


def _fingerprint(columns: list[str]) -> dict[str, Column]:
    """Two hashes of a row in pieces that can be added up.

    Which columns are NULL enters as a text of its own, as the hash passes over NULLs.
    """
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    hashes = [F.xxhash64(F.lit(seed), nulls, *[F.col(c) for c in columns]) for seed in (17, 92821)]
    mask = F.lit((1 << PIECE_BITS) - 1).cast("bigint")
    return {
        f"h{i}_{shift}": F.shiftrightunsigned(h, shift).bitwiseAND(mask)
        for i, h in enumerate(hashes)
        for shift in PIECES
    }


def fingerprint_cells(source: DataFrame, target: DataFrame, width: int) -> DataFrame:
    """Rows of both sides by (report period, range of ``width`` ids), and whether they are equal.

    A cell is equal when both sides hold as many rows and the sums of their row hashes agree.
    Order plays no part and copies count. A task sends one row for each cell it met, however
    many rows these stand for and however wide they are.
    """
    aligned = target.select(*[F.col(f.name).cast(f.dataType) for f in source.schema.fields])
    pieces = _fingerprint(source.columns)
    cell = [F.col(PARTITION_COLUMN).alias("period"), _id_range(width).alias("id_range")]
    sides = [
        side.select(
            *cell,
            F.lit(int(sign > 0)).alias("ours"),
            F.lit(int(sign < 0)).alias("theirs"),
            *[(F.lit(sign) * piece).alias(name) for name, piece in pieces.items()],
        )
        for side, sign in ((source, 1), (aligned, -1))
    ]
    cells = sides[0].unionByName(sides[1]).groupBy("period", "id_range").agg(
        F.sum("ours").alias("source_rows"),
        F.sum("theirs").alias("target_rows"),
        *[F.sum(name).alias(name) for name in pieces],
    )
    equal = F.col("source_rows") == F.col("target_rows")
    for name in pieces:
        equal = equal & (F.col(name) == 0)
    return cells.select("period", "id_range", "source_rows", "target_rows", equal.alias("equal"))


def _id_range(width: int) -> Column:
    return F.floor(F.col(CLUSTER_COLUMN) / F.lit(width))


def reconcile_cells(source: DataFrame, target: DataFrame, width: int = 64) -> DataFrame:
    """``load_reconciliation`` that compares whole rows only where fingerprints differ.

    The cells come first and are written; rows of the cells that differ are then read again and
    compared as they are. Also returned: how many cells there are, and how many differ. Rows that
    differ in a cell whose sums agree would go unseen; for two 64-bit hashes that is chance alone.
    """
    cells = materialise(fingerprint_cells(source, target, width), "cells")
    off = cells.filter(~F.col("equal")).select("period", "id_range")
    same = F.col(PARTITION_COLUMN).eqNullSafe(F.col("period")) & _id_range(width).eqNullSafe(F.col("id_range"))
    parts = [side.join(off, same, "left_semi") for side in (source, target)]
    rows = load_reconciliation(*parts).agg(F.struct(F.max("missing").alias("missing"), F.max("extra").alias("extra")))
    none = F.lit(0).cast("bigint")
    totals = cells.agg(
        F.coalesce(F.sum("source_rows"), none).alias("source_rows"),
        F.coalesce(F.sum("target_rows"), none).alias("target_rows"),
        F.count("*").alias("cells"),
        F.count_if(~F.col("equal")).alias("cells_differing"),
    )
    return totals.select("*", rows.scalar().alias("rows")).select(
        "source_rows", "target_rows", "rows.missing", "rows.extra", "cells", "cells_differing"
    )
