"""Ranks and quartiles of income without a task per year.

``RANK() OVER (PARTITION BY report_year ...)`` moves a whole year to one task.
Instead, at every size:

1. provider-years collapse to distinct incomes with their counts, so any number
   of equal incomes is one row;
2. incomes fall into buckets of fixed width, buckets into wider buckets, and so
   on, so that no window ever holds more than ``FANOUT`` rows;
3. rows before an income = rows before it in its bucket + rows before the
   bucket, and the two ranks follow;
4. the ranks are joined back on (year, income).

Bucket borders come from the value alone, not from a sample, so recomputed
tasks agree with each other.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wardledger.functions.sums import largest, mean, smallest, summarise, total_count
from wardledger.session import materialise

# Sums of four-decimal amounts are close to multiples of 1/10,000, a last bit or two off: a
# bucket of 10 holds a few hundred thousand different ones, and each wider bucket a million
# narrower ones.
FIRST_BUCKET = 10.0
FANOUT = 1_000_000.0
LEVELS = 3

_BEFORE_ALL = (Window.unboundedPreceding, -1)


def _before(column: str, window) -> Column:
    return F.coalesce(F.sum(column).over(window.rowsBetween(*_BEFORE_ALL)), F.lit(0))


def _null_safe(left: DataFrame, right: DataFrame, names: list[tuple[str, str]]) -> Column:
    condition = F.lit(True)
    for ours, theirs in names:
        condition = condition & left[ours].eqNullSafe(right[theirs])
    return condition


def _positions(values: DataFrame, width: float, levels: int, descending: bool) -> DataFrame:
    """Add ``rows_before`` and ``values_before`` within each group.

    ``values`` has one row per (grp, key) with ``n_rows`` and ``n_values``.
    """
    order = F.desc_nulls_last("key") if descending else F.asc_nulls_first("key")
    if levels == 0:
        group = Window.partitionBy("grp").orderBy(order)
        return values.select(
            "*",
            _before("n_rows", group).alias("rows_before"),
            _before("n_values", group).alias("values_before"),
        )
    bucketed = values.withColumn("bucket", F.floor(F.col("key") / F.lit(width)))
    inside = Window.partitionBy("grp", "bucket").orderBy(order)
    local = bucketed.select(
        "*",
        _before("n_rows", inside).alias("rows_inside"),
        _before("n_values", inside).alias("values_inside"),
    )
    wider = bucketed.groupBy("grp", "bucket").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values")
    )
    above = _positions(
        wider.withColumnRenamed("bucket", "key"), FANOUT, levels - 1, descending
    ).select(
        F.col("grp").alias("above_grp"),
        F.col("key").alias("above_bucket"),
        "rows_before",
        "values_before",
    )
    return local.join(
        above, _null_safe(local, above, [("grp", "above_grp"), ("bucket", "above_bucket")])
    ).select(
        "grp",
        "key",
        "n_rows",
        "n_values",
        (F.col("rows_inside") + F.col("rows_before")).alias("rows_before"),
        (F.col("values_inside") + F.col("values_before")).alias("values_before"),
    )


def value_positions(
    df: DataFrame, group: Column, value: str, descending: bool = True
) -> DataFrame:
    """Distinct values of each group with the rows and values that precede them.

    Returns ``grp, key, n_rows, n_values, rows_before, values_before``.
    """
    values = df.groupBy(group.alias("grp"), F.col(value).alias("key")).agg(
        F.count("*").alias("n_rows"), F.lit(1).cast("bigint").alias("n_values")
    )
    return _positions(values, FIRST_BUCKET, LEVELS, descending)


def rank_incomes_in_one_task(rows: DataFrame) -> DataFrame:
    """RANK and DENSE_RANK by plain windows, for rows that a limit has brought to one task."""
    year = Window.partitionBy("report_year").orderBy(F.desc_nulls_last("total_net_income"))
    return rows.select(
        "*",
        F.rank().over(year).cast("bigint").alias("income_rank"),
        F.dense_rank().over(year).cast("bigint").alias("dense_income_rank"),
    )


def rank_incomes_by_value(rows: DataFrame) -> DataFrame:
    """RANK and DENSE_RANK through distinct values.

    The join back is an equi-join; equal incomes of many providers make one
    hot key on the side of ``rows`` only, which adaptive execution splits.
    """
    ranks = value_positions(rows, F.col("report_year"), "total_net_income").select(
        F.col("grp").alias("ranked_year"),
        F.col("key").alias("ranked_income"),
        (F.col("rows_before") + 1).alias("income_rank"),
        (F.col("values_before") + 1).alias("dense_income_rank"),
    )
    same = _null_safe(
        rows, ranks, [("report_year", "ranked_year"), ("total_net_income", "ranked_income")]
    )
    return rows.join(ranks, same).drop("ranked_year", "ranked_income")


def rank_incomes(rows: DataFrame) -> DataFrame:
    """Rank all provider-years by income within their year.

    ``rows`` is written once, because the ranks and their join back both read it.
    """
    return rank_incomes_by_value(materialise(rows, "provider-years"))


def _tile_sums(pieces: DataFrame) -> DataFrame:
    """Summary per tile of ``tile, key, providers``: income and how many have it."""
    return summarise(
        pieces,
        {"quartile": F.col("tile").cast("bigint")},
        {
            "providers": total_count("providers"),
            "min_net_income": smallest("key"),
            "max_net_income": largest("key"),
            "avg_net_income": mean("key", weight="providers"),
        },
    )


def income_quartiles(ranked: DataFrame, tiles: int = 4) -> DataFrame:
    """NTILE over all known incomes, summed up per tile.

    Providers with the same income are interchangeable for these sums, so a
    tile border inside a run of equal incomes only splits its count. Tiles follow
    from the positions of the distinct incomes, and no row order has to be built.
    """
    known = ranked.filter(F.col("total_net_income").isNotNull())
    # One group over everything: the buckets keep its windows bounded.
    values = value_positions(known, F.lit(1), "total_net_income", descending=False)
    size = known.select(F.count("*")).scalar()
    base, extra = F.floor(size / tiles), size % tiles
    bounds = [
        F.struct(
            F.lit(t + 1).alias("tile"),
            (t * base + F.least(F.lit(t), extra)).alias("start"),
            ((t + 1) * base + F.least(F.lit(t + 1), extra)).alias("end"),
        )
        for t in range(tiles)
    ]
    shared = F.least("end", F.col("rows_before") + F.col("n_rows")) - F.greatest(
        "start", "rows_before"
    )
    return _tile_sums(
        values.select("*", F.inline(F.array(*bounds)))
        .select("tile", "key", shared.alias("providers"))
        .filter(F.col("providers") > 0)
    )
