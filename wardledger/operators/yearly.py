"""The flagship analysis: provider-years, income ranks, year-over-year change."""

from pyspark.sql import DataFrame, Window, functions as F

from wardledger.functions.dates import report_year, year_equals
from wardledger.functions.sums import mean, summarise, summary_ctes, total
from wardledger.operators.ranking import (
    rank_incomes,
    rank_incomes_in_one_task,
)

FLAGSHIP_COLUMNS = [
    "provider_id",
    "report_year",
    "total_expenses",
    "avg_charges",
    "total_net_income",
    "income_rank",
    "dense_income_rank",
    "prev_net_income",
    "next_net_income",
    "yoy_change",
]


def cost_reports(
    stg: DataFrame,
    min_beds: int = 50,
    year: int | None = None,
    id_range: tuple[int, int] | None = None,
) -> DataFrame:
    """Staging rows of hospitals with more than ``min_beds`` beds.

    ``year`` prunes date partitions, ``id_range`` (inclusive) skips row groups
    of files sorted by provider.
    """
    kept = stg.filter(F.col("beds_number") > min_beds)
    if year is not None:
        kept = kept.filter(year_equals(F.col("report_period"), year))
    if id_range is not None:
        kept = kept.filter(F.col("provider_id").between(*id_range))
    return kept


def yearly_summary(reports: DataFrame) -> DataFrame:
    """One row per provider and year.

    Partial sums are formed before the shuffle, so a provider holding a large
    part of all rows sends one row per task.
    """
    keys = {"provider_id": F.col("provider_id"), "report_year": report_year(F.col("report_period"))}
    return summarise(
        reports,
        keys,
        {
            "total_expenses": total("total_expenses"),
            "avg_charges": mean("total_charges"),
            "total_net_income": total("net_income"),
        },
    )


def with_neighbour_years(summary: DataFrame) -> DataFrame:
    """Add the income of the previous and next year present, and the change.

    A window holds the years of one provider: at most one row per calendar
    year, whatever the number of cost reports behind it.
    """
    years = Window.partitionBy("provider_id").orderBy("report_year")
    previous = F.lag("total_net_income").over(years)
    return summary.select(
        "*",
        previous.alias("prev_net_income"),
        F.lead("total_net_income").over(years).alias("next_net_income"),
        (F.col("total_net_income") - previous).alias("yoy_change"),
    )


def flagship(
    stg: DataFrame,
    year: int | None = None,
    id_range: tuple[int, int] | None = None,
    limit: int | None = 100,
    min_beds: int = 50,
) -> DataFrame:
    """Income ranks and year-over-year change of every provider-year.

    Filters apply before the windows: a filter on one year leaves no
    neighbouring years to look at.

    With a limit, the report is cut *before* ranking. Its order is year, then
    falling income, and a rank depends only on rows earlier in that order, so
    ranks inside the first ``limit`` rows equal the ranks over all rows. The
    limit brings its rows to one task, and ranking them there adds nothing to it.
    """
    rows = with_neighbour_years(
        yearly_summary(cost_reports(stg, min_beds, year, id_range))
    )
    report_order = ["report_year", "income_rank", "provider_id"]
    if limit is None:
        return rank_incomes(rows).select(*FLAGSHIP_COLUMNS)
    first = rows.orderBy(
        F.asc_nulls_first("report_year"),
        F.desc_nulls_last("total_net_income"),
        "provider_id",
    ).limit(limit)
    return (
        rank_incomes_in_one_task(first).select(*FLAGSHIP_COLUMNS).orderBy(*report_order)
    )


# The flagship query as SQL text over a registered view. The sums are filled in
# from ``sums``; ``first_rows`` cuts the report before ranking, for the reason
# given in ``flagship``.
FLAGSHIP_SQL = """
WITH {sums},
yearly_summary AS (
  SELECT provider_id, report_year,
         {expenses} AS total_expenses,
         try_divide({charges}, {n_charges}) AS avg_charges,
         {income} AS total_net_income
  FROM merged
),
neighbours AS (
  SELECT *,
         lag(total_net_income) OVER (PARTITION BY provider_id ORDER BY report_year) AS prev_net_income,
         lead(total_net_income) OVER (PARTITION BY provider_id ORDER BY report_year) AS next_net_income
  FROM yearly_summary
),
first_rows AS (
  SELECT * FROM neighbours
  ORDER BY report_year, total_net_income DESC, provider_id
  LIMIT 100
)
SELECT provider_id, report_year, total_expenses, avg_charges, total_net_income,
       CAST(rank() OVER (PARTITION BY report_year ORDER BY total_net_income DESC) AS BIGINT) AS income_rank,
       CAST(dense_rank() OVER (PARTITION BY report_year ORDER BY total_net_income DESC) AS BIGINT) AS dense_income_rank,
       prev_net_income, next_net_income,
       total_net_income - prev_net_income AS yoy_change
FROM first_rows
ORDER BY report_year, income_rank, provider_id
"""


def flagship_sql(stg: DataFrame, view: str) -> DataFrame:
    """Register ``stg`` as a view and run the flagship query as SQL text."""
    stg.createOrReplaceTempView(view)
    sums, texts = summary_ctes(
        view,
        {"provider_id": "provider_id", "report_year": "CAST(year(report_period) AS BIGINT)"},
        ["total_expenses", "total_charges", "net_income"],
        "beds_number > 50",
    )
    text = FLAGSHIP_SQL.format(
        sums=sums,
        expenses=texts["total_expenses"][0],
        charges=texts["total_charges"][0],
        n_charges=texts["total_charges"][1],
        income=texts["net_income"][0],
    )
    return stg.sparkSession.sql(text)


def top_k_per_year(ranked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best incomes of each year, ties included."""
    return ranked.filter(F.col("income_rank") <= k).select(
        "provider_id", "report_year", "total_net_income", "income_rank", "total_expenses"
    )


def growth_counts(ranked: DataFrame) -> DataFrame:
    """Growing, declining and flat providers per year."""
    change = F.col("yoy_change")
    return ranked.groupBy("report_year").agg(
        F.count_if(change > 0).alias("growing"),
        F.count_if(change < 0).alias("declining"),
        F.count_if(change == 0).alias("flat"),
        F.count_if(change.isNull()).alias("no_prior"),
    )


def rank_distribution(ranked: DataFrame) -> DataFrame:
    """How many provider-years hold each income rank."""
    return ranked.groupBy("income_rank").agg(F.count("*").alias("providers"))
