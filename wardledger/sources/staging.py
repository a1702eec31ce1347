"""CSV sources and the date-partitioned, provider-sorted staging table."""

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from wardledger.functions.sizes import logical_bytes
from wardledger.operators.quality import enforce_required
from wardledger.schema import (
    CLUSTER_COLUMN,
    EXTERNAL_SCHEMA,
    NATIVE_NAMES,
    NATIVE_SCHEMA,
    PARTITION_COLUMN,
    REQUIRED_COLUMNS,
)
from wardledger.sources import versions


def read_csv(
    spark: SparkSession, paths: str | list[str], schema: T.StructType = NATIVE_SCHEMA
) -> DataFrame:
    """CSV files with a header line, bound to ``schema`` by position.

    Paths may be globs; all matching files are concatenated, copies included.
    A row that does not fit the schema fails the read.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .csv(paths)
    )


def read_external(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The external table: CSV files queried in place, under external names."""
    return read_csv(spark, paths, EXTERNAL_SCHEMA)


def native_names(external: DataFrame) -> DataFrame:
    return external.withColumnsRenamed(NATIVE_NAMES)


#: Compressed CSV files cannot be split, so a file, which is a task of its reader, holds a bounded
#: number of rows. The fastest level takes no longer than writing plain text.
COMPRESSED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1 << 20}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", compressed: bool = False) -> None:
    df.write.mode(mode).option("header", True).options(**(COMPRESSED if compressed else {})).csv(path)


class Load(NamedTuple):
    """What a load wrote, counted while it was written."""

    rows: int
    logical_bytes: int
    scanned_bytes: int
    periods: int
    null_values: dict[str, int]


def clustered(df: DataFrame, seen: tuple[Observation, list] | None = None) -> DataFrame:
    """Lay rows out for a table partitioned by date and clustered by provider.

    Tasks take ranges of (date, provider): the files of a date that is split over
    tasks hold ids that do not overlap, so a range of ids opens few of them. A hash
    of the row ends the key and splits a provider of any size. Adaptive execution
    joins small ranges that are neighbours.

    With ``seen``, an observation and its measures, rows are counted on their way from the
    shuffle to the sort: after the shuffle, so that the sampling of the ranges does not count
    them a second time, and before the sort, so that the files keep its order.
    """
    row = F.xxhash64(*[F.col(name) for name in df.columns])
    dealt = df.repartitionByRange(PARTITION_COLUMN, CLUSTER_COLUMN, row)
    if seen is not None:
        dealt = dealt.observe(seen[0], *seen[1])
    return dealt.sortWithinPartitions(PARTITION_COLUMN, CLUSTER_COLUMN)


def write_staging(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write the staging table; ``overwrite`` truncates, ``append`` adds."""
    clustered(enforce_required(df)).write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path)


def write_measured(
    df: DataFrame, path: str, mode: str = "overwrite", scanned: list[str] | None = None
) -> Load:
    """``write_staging``, and what it wrote; the counts ride on the write and need no scan.

    ``scanned`` are the columns that a reader of the load is to be charged for, all by default.
    The dates of the table are held by the driver, one value for each partition folder.
    """
    required = [c for c in REQUIRED_COLUMNS if c in df.columns]
    none = F.lit(0).cast("bigint")
    measures = [
        F.count("*").alias("rows"),
        F.coalesce(F.sum(logical_bytes(df.schema)), none).alias("logical_bytes"),
        F.coalesce(F.sum(logical_bytes(df.schema, scanned)), none).alias("scanned_bytes"),
        F.collect_set(F.coalesce(F.col(PARTITION_COLUMN).cast("string"), F.lit(""))).alias("periods"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required],
    ]
    seen = Observation()
    written = clustered(enforce_required(df), (seen, measures))
    written.write.mode(mode).partitionBy(PARTITION_COLUMN).parquet(path)
    found = seen.get
    return Load(
        found["rows"], found["logical_bytes"], found["scanned_bytes"], len(found["periods"]),
        {c: found[f"null_{c}"] for c in required},
    )


def read_staging(
    spark: SparkSession, path: str, schema: T.StructType = NATIVE_SCHEMA
) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_staging(
    spark: SparkSession, csv_paths: str | list[str], path: str, mode: str = "overwrite"
) -> DataFrame:
    """Load CSV files into the staging table and return the table.

    A bad row or a missing required value fails the write before it commits.
    """
    write_staging(read_csv(spark, csv_paths), path, mode)
    return read_staging(spark, path)


def replace_table(df: DataFrame, path: str) -> versions.Version:
    """Truncate and load a versioned table; readers see the old rows until all new ones are there."""
    return versions.load(clustered(enforce_required(df)), path, "overwrite")


def load_batch(df: DataFrame, path: str, batch: str) -> versions.Version:
    """Append a batch to a versioned table, once however often it is repeated."""
    return versions.load(clustered(enforce_required(df)), path, "append", batch)


def recreate_table(df: DataFrame, name: str, path: str, partition_by: list[str]) -> DataFrame:
    """Replace the catalog table ``name`` by ``df``, stored under the unused ``path``.

    The new files are complete before the old table is dropped, so a load that
    fails leaves the old table as it was.
    """
    spark = df.sparkSession
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    table = spark.catalog.createTable(name, path=path, source="parquet")
    if partition_by:
        spark.catalog.recoverPartitions(name)
    return table


def connection_probe(spark: SparkSession) -> DataFrame:
    """One constant row, to see that the session answers."""
    return spark.range(1).select(
        F.lit(1).alias("test_value"), F.lit("connection_test").alias("test_message")
    )


def partition_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per date partition of each named table."""
    counts = [
        table.groupBy(PARTITION_COLUMN)
        .agg(F.count("*").alias("records"))
        .select(F.lit(name).alias("table_name"), PARTITION_COLUMN, "records")
        for name, table in tables.items()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result
