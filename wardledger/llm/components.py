"""Connected components of an edge table by alternating star operations.

Each round rewrites the edges: *large star* points every larger neighbour of a vertex at
the smallest of its neighbourhood, *small star* does so for the smaller ones. Both only need
the minimum per vertex, which is summed up before its shuffle; no neighbourhood is ever
gathered. Rounds end when no edge changes, which takes a number of rounds logarithmic in the
size of a component. The edges of each round are a written table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardledger.llm.shared import drop_tables, write_table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if large:
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = both.where("b < a")
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b), component the smallest vertex."""
    spark = edges.sparkSession
    now, path = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), mark.alias("mark")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        after, after_path = write_table(_star(_star(now, True), False), "edges")
        drop_tables(spark, path)
        now, path = after, after_path
    roots = now.select("b").distinct().select(F.col("b").alias("vertex"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
