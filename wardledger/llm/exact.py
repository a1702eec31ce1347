"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Each input partition first reduces its rows to one entry per digest (a *run*). Runs then
meet in binomial rounds: in a round, the runs whose numbers agree but for their last
``FAN_BITS`` bits are merged into one, and of each digest the merged run retains the
identifier to keep and the number of rows. A digest that a third of all rows share is one
entry per run from the first step on, and no task ever holds more than its share of the
entries, as every merge is dealt out by (run, digest).

Retained identifiers are verified at every level: entries merge only when the SHA-256
digest *and* the byte length agree, and the row kept is the one whose identifier is an
extreme of all entries below it.

Defined results: NULL text is empty; letters other than A-Z are not folded; a NULL doc_id
is smaller than any other and is only kept when all ids of the group are NULL; of rows that
repeat the kept doc_id and text, one is kept; an empty table gives an empty result; columns
of other names are ignored, or pass through ``drop_exact_duplicates``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardledger.llm.shared import fold_ascii, table, write_table, unused_names

#: Runs that meet in one round: 2 ** FAN_BITS.
FAN_BITS = 4
KEY = ["text_sha256", "n_bytes"]


def _normalised(text: Column) -> Column:
    return fold_ascii(F.coalesce(text, F.lit("")))


def _retain(entries: DataFrame, keys: list[str], keep: str) -> DataFrame:
    """One entry per key: the row to keep, its id, and the rows and top rows of the group."""
    pick = F.max if keep == "largest" else F.min
    return entries.groupBy(*keys).agg(pick("top").alias("top"), F.sum("group_size").alias("group_size"))


def merge_runs(digests: DataFrame, runs: int, keep: str = "largest") -> DataFrame:
    """Tree merge of (run, text_sha256, n_bytes, top, group_size) entries into one run."""
    entries = _retain(digests, ["run", *KEY], keep)
    while runs > 1:
        entries = entries.withColumn("run", F.shiftright("run", FAN_BITS))
        entries = _retain(entries, ["run", *KEY], keep)
        runs = -(-runs >> FAN_BITS) if runs >= 1 << FAN_BITS else 1
    return entries.drop("run")


def mark_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row."""
    text = _normalised(F.col("text"))
    rows, _ = write_table(
        docs.select(
            "doc_id",
            F.sha2(text, 256).alias("text_sha256"),
            F.octet_length(text).cast("long").alias("n_bytes"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    # The upper bits of the row number are the number of the partition it came from.
    run = F.shiftright("row", 33)
    runs = (rows.agg(F.max(run)).first()[0] or 0) + 1
    entries = rows.select(
        run.alias("run"), *KEY, F.struct("doc_id", "row").alias("top"), F.lit(1).cast("long").alias("group_size")
    )
    groups = merge_runs(entries, runs, keep)
    return rows.join(groups, KEY).select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("top.row")).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are found again by doc_id and digest; a digest has one kept id, so texts that many
    rows share are no hot key. Rows that repeat both are neighbours then, and one is taken.
    """
    own, digest, copy = unused_names(docs, "__id", "__digest", "__copy")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    marked = mark_duplicates(docs, keep).where("kept").select(key.alias(own), F.col("text_sha256").alias(digest))
    found = docs.withColumns({own: key, digest: F.sha2(_normalised(F.col("text")), 256)})
    same = Window.partitionBy(own, digest).orderBy(own)
    return (
        found.join(marked, [own, digest], "left_semi")
        .withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1)
        .select(*docs.columns)
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
