"""Timestamped landing batches and file metadata."""

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardledger.functions.dates import BATCH_STAMP
from wardledger.functions.sizes import MIB, in_unit, logical_bytes
from wardledger.schema import NATIVE_SCHEMA, PARTITION_COLUMN

# Any name that begins like this, up to its extension; the last stamp in it counts, as a
# batch that is uploaded again gets a second one.
BATCH_PATTERN = r"hospital_cost_sample[^/]*?(?=\.csv|/|$)"
LAST_STAMP = r".*(\d{8}_\d{6})"


def land(df: DataFrame, path: str) -> None:
    """Append rows to the landing folder, one sub-folder per ``batch_name``."""
    (
        df.hint("rebalance", "batch_name")
        .write.mode("append")
        .partitionBy("batch_name")
        .option("header", True)
        .csv(path)
    )


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with size and time of change.

    The content column of the source is never selected, so no file is opened.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def newest_batch(files: DataFrame) -> DataFrame:
    """Name and load time of the newest batch, as one row.

    The last time inside the name decides, and of equal times the larger name. A
    name without a time comes before all others.
    """
    name = F.regexp_extract("path", BATCH_PATTERN, 0)
    named = files.select(name.alias("batch_name")).filter(F.col("batch_name") != "")
    stamp = F.nullif(F.regexp_extract("batch_name", LAST_STAMP, 1), F.lit(""))
    newest = F.max(F.struct(F.try_to_timestamp(stamp, F.lit(BATCH_STAMP)).cast("timestamp_ntz").alias("ts"), "batch_name"))
    return named.agg(newest.alias("newest")).select(
        F.col("newest.batch_name").alias("batch_name"), F.col("newest.ts").alias("batch_ts")
    )


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType = NATIVE_SCHEMA
) -> DataFrame:
    """All batches, with ``batch_name`` as partition column."""
    landed = T.StructType([*schema.fields, T.StructField("batch_name", T.StringType())])
    return (
        spark.read.schema(landed)
        .option("header", True)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Newest batch with its row count.

    The one-row side prunes the landing partitions at run time, so only the
    newest batch is read.
    """
    newest = newest_batch(list_files(spark, path))
    rows = read_landing(spark, path).select("batch_name")
    return (
        rows.join(F.broadcast(newest), "batch_name")
        .groupBy("batch_name", "batch_ts")
        .agg(F.count("*").alias("rows"))
    )


def storage_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Size and time of change of every file of a table."""
    return list_files(spark, path).select(
        F.col("path").alias("file_path"),
        F.col("length").alias("size_bytes"),
        in_unit(F.col("length"), MIB).alias("size_mb"),
        F.col("modificationTime").alias("modified_at"),
    )


def table_storage(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """Files, rows, date partitions, logical and stored bytes of a table, as one row.

    The rows are read once, as texts count by their length; partial sums by date leave a task.
    The ratio of an empty table is 0.
    """
    per_day = table.groupBy(PARTITION_COLUMN).agg(
        F.count("*").alias("n"), F.sum(logical_bytes(table.schema)).alias("bytes")
    )
    none = F.lit(0).cast("bigint")
    totals = per_day.agg(
        F.coalesce(F.sum("n"), none).alias("num_rows"),
        F.count("*").alias("num_partitions"),
        F.coalesce(F.sum("bytes"), none).alias("logical_bytes"),
    )
    size = list_files(spark, path).agg(
        F.struct(F.coalesce(F.sum("length"), none).alias("bytes"), F.count("*").alias("files"))
    )
    physical = F.col("stored.bytes")
    return totals.select("*", size.scalar().alias("stored")).select(
        F.col("stored.files").alias("files"),
        "num_rows",
        "num_partitions",
        "logical_bytes",
        physical.alias("physical_bytes"),
        in_unit(F.col("logical_bytes"), MIB).alias("logical_mb"),
        in_unit(physical, MIB).alias("physical_mb"),
        F.coalesce(F.try_divide(physical, F.col("logical_bytes")), F.lit(0.0)).alias("compression_ratio"),
    )
