"""Line dedup: sorted line hashes, and keep bitmaps for each document instead of text.

The lines of all documents become rows (hash, document, position). They are dealt out by
ranges of (hash, document) and sorted by hash, document and position within a range, so a
line found in a third of all documents spreads over many ranges. A task streams its range:
of each hash it knows the number of documents and the first occurrence without holding more
than ``CHUNK`` occurrences. Hashes that may continue in a neighbouring range, or reach the
limit in this one, leave as packed postings; one small aggregation adds up their parts. The
occurrences to drop go back to their documents as positions, which become a compressed
bitmap: one bit for each line, deflated.

Defined results: a NULL or empty text is one empty line, and it stays; rows with equal ids
and different texts are documents of their own; rows that repeat id and text are one
document, and each gets its row; an empty table gives an empty result. A key is told by its 128-bit hash. A key counts once for a document.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import as_bytes, pack, shuffle_partitions, table, unpack, write_table

CHUNK = 1 << 16
SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    return line.strip(SPACE).lower()


def _length(key: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return sum(b & 0xC0 != 0x80 for b in key) if not key.isascii() else len(key)


def _lines(least):
    """Rows (row, text) -> (high, low, row, position) of the lines whose keys are long enough."""

    def run(batches):
        for batch in batches:
            high, low, rows, positions = [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                for position, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _length(key) >= least:
                        value = xxhash.xxh3_128_intdigest(key)
                        high.append((value >> 64) - (1 << 63))
                        low.append((value & (1 << 64) - 1) - (1 << 63))
                        rows.append(row)
                        positions.append(position)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (high, low, rows, positions)], ["high", "low", "row", "position"]
            )

    return run


POSTINGS = "high long, low long, n long, first_row long, first_position long, rows binary, positions binary"


def _stream(limit):
    """A sorted range of lines -> packed postings of hashes that may reach the limit."""

    def postings(key, n, rows, positions, first):
        return {
            "high": key[0], "low": key[1], "n": n, "first_row": first[0], "first_position": first[1],
            "rows": np.array(rows, "<i8").tobytes(), "positions": pack(np.array(positions, np.int64)),
        }

    def run(batches):
        key, n, first, rows, positions, opening, split = None, 0, None, [], [], True, False
        schema = pa.schema([
            *((k, pa.int64()) for k in ("high", "low", "n", "first_row", "first_position")),
            ("rows", pa.binary()), ("positions", pa.binary()),
        ])
        for batch in batches:
            out = []
            for high, low, row, position in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != (high, low):
                    if key is not None:
                        if opening or split or n >= limit:
                            out.append(postings(key, n, rows, positions, first))
                        opening = False
                    key, n, first, rows, positions, split = (high, low), 0, (row, position), [], [], False
                if not rows or rows[-1] != row:
                    if len(rows) >= CHUNK:  # only between documents: each counts once
                        out.append(postings(key, n, rows, positions, first))
                        n, rows, positions, split = 0, [], [], True
                    n += 1
                rows.append(row)
                positions.append(position)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        if key is not None:  # the last hash may continue in the next range
            yield pa.RecordBatch.from_pylist([postings(key, n, rows, positions, first)], schema=schema)

    return run


def _positions(first_stays):
    def run(batches):
        for batch in batches:
            rows, positions = [], []
            for r in batch.to_pylist():
                own, at = np.frombuffer(r["rows"], "<i8"), unpack(r["positions"]).astype(np.int64)
                if first_stays:
                    stay = (own == r["keep_row"]) & (at == r["keep_position"])
                    own, at = own[~stay], at[~stay]
                rows.append(own)
                positions.append(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (rows, positions)],
                ["row", "position"],
            )

    return run


def bitmap(dropped: list[int]) -> bytes:
    """Deflated keep bits, least significant bit first; lines beyond the last bit stay."""
    keep = np.ones((max(dropped) // 8 + 1) * 8, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes())


def keep_bits(data: bytes | None, n_lines: int) -> np.ndarray:
    """Whether each of the lines of a document stays; without a bitmap all do."""
    keep = np.ones(n_lines, bool)
    if data:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), bitorder="little")
        keep[: len(bits)] = bits[:n_lines]
    return keep


def _bitmaps(batches):
    for batch in batches:
        made = [bitmap(sorted(d)) for d in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["row", "keep"])


def _row(text) -> Column:
    return F.xxhash64("doc_id", text)


def keep_bitmaps(docs: DataFrame, least: int = 1, limit: int = 10, first_stays: bool = False) -> DataFrame:
    """(row, keep) of the documents that lose lines; ``keep`` is a bitmap, see ``keep_bits``.

    ``row`` is the 64-bit hash of id and text. Lines whose key has at least ``least`` code
    points and stands in ``limit`` documents or more are dropped; with ``first_stays`` the
    first occurrence of each, by row and position, is kept.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    lines, _ = write_table(
        docs.select(_row(text).alias("row"), text.alias("text"))
        .mapInArrow(_lines(least), "high long, low long, row long, position long"),
        "lines",
    )
    ranges = lines.repartitionByRange(shuffle_partitions(spark), "high", "low", "row")
    ranges = ranges.sortWithinPartitions("high", "low", "row", "position")
    postings, _ = write_table(ranges.mapInArrow(_stream(limit), POSTINGS), "postings")
    first = F.min(F.struct("first_row", "first_position"))
    # A document's occurrences of a hash lie in one range and one chunk, so parts add up.
    often = postings.groupBy("high", "low").agg(F.sum("n").alias("n"), first.alias("f")).where(F.col("n") >= limit)
    keep = [F.col("f.first_row").alias("keep_row"), F.col("f.first_position").alias("keep_position")]
    frequent = postings.drop("n").join(often.select("high", "low", *keep), ["high", "low"])
    return (
        frequent.select("rows", "positions", "keep_row", "keep_position")
        .mapInArrow(_positions(first_stays), "row long, position long")
        .groupBy("row").agg(F.collect_set("position").alias("dropped"))
        .mapInArrow(_bitmaps, "row long, keep binary")
    )


def _apply(batches):
    for batch in batches:
        counts, lost, digests = [], [], []
        for text, keep in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
            lines = text.split(b"\n")
            stay = keep_bits(keep, len(lines))
            if keep:
                text = b"\n".join(line for line, k in zip(lines, stay) if k)
            counts.append(len(lines))
            lost.append(int((~stay).sum()))
            digests.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_report(docs: DataFrame, least: int = 1, limit: int = 10) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row, from its bitmap."""
    text = F.coalesce("text", F.lit(""))
    numbered = docs.select("doc_id", text.alias("text"), _row(text).alias("row"))
    return (
        numbered.join(keep_bitmaps(docs, least, limit), "row", "left").select("doc_id", "text", "keep")
        .mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line,
  translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(lines) + 1)) AS u(i)),
f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY doc_id
"""
