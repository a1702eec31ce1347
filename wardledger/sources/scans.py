"""What the file scans of a query read, from the metrics of its executed plan."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from wardledger.functions.money import percent


class Scan(NamedTuple):
    files: int
    file_bytes: int
    partitions: int
    rows_read: int
    rows: int


def _scans(plan) -> list:
    """The file scans of an executed plan, through the stages adaptive execution made of it."""
    kind = plan.getClass().getSimpleName()
    if kind == "FileSourceScanExec":
        return [plan]
    if kind == "AdaptiveSparkPlanExec":
        return _scans(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _scans(plan.plan())
    children = plan.children()
    return [scan for i in range(children.size()) for scan in _scans(children.apply(i))]


def _metric(plan, name: str) -> int:
    found = plan.metrics().get(name)
    return found.get().value() if found.isDefined() else 0


def scanned(df: DataFrame) -> Scan:
    """Run ``df``, and total up the files, bytes, partitions and rows its scans took.

    All columns of ``df`` are computed, but only a count and one hash leave the tasks. A file
    counts with its whole size when a scan opens it, though only the row groups and columns that
    are asked for are read of it. A stage that is used twice counts each time.
    """
    once = df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*[F.col(c) for c in df.columns])))
    rows = once.collect()[0]["rows"]
    scans = _scans(once._jdf.queryExecution().executedPlan())
    names = ("numFiles", "filesSize", "numPartitions", "numOutputRows")
    return Scan(*[sum(_metric(scan, name) for scan in scans) for name in names], rows)


def scan_reduction(table: DataFrame, kept: Column) -> DataFrame:
    """What a predicate saves of reading ``table``: both reads are run and measured; one row."""
    everything, part = scanned(table), scanned(table.filter(kept))
    names = {"files": "files", "file_bytes": "bytes", "partitions": "partitions", "rows_read": "rows_read", "rows": "rows"}
    values = {f"{side}_{name}": getattr(scan, field) for side, scan in (("total", everything), ("kept", part)) for field, name in names.items()}
    row = table.sparkSession.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in values.items()])
    saved = percent(F.col("total_bytes") - F.col("kept_bytes"), F.col("total_bytes"))
    return row.select("*", F.round(saved, 1).alias("bytes_saved_pct"))
