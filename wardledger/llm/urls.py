"""URL filter: a blocked Bloom filter before an exact hash join with the listed entries.

An entry (host, path, verdict) lists a host with its subdomains and a path prefix. Each
URL in canonical form (host in lower case, path without query and fragment) yields one key
for every host suffix and every prefix length that occurs in the list. A key addresses one
64-byte block of the filter and sets ``PROBES`` bits inside it. Keys that the filter
passes go on to an exact hash join, which removes the false positives; of the entries that
fit, the longest wins.

The filter is the only thing every task holds. Its size follows the list up to
``MAX_FILTER_BYTES``; a longer list only raises the share of false positives, and the join
stays exact. Rows whose keys the filter drops never reach a shuffle.

Defined results: a NULL url or one without ``://`` has an empty host and path and fits no
entry; URLs that fit none are allowed; entries with a NULL host or path fit nothing;
repeated entries count once (of contradicting ones, ``allow`` comes first); repeated pages
each get their row; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import as_bytes, fold_ascii, table, write_table

BITS_PER_KEY = 16
PROBES = 8
BLOCK_BYTES = 64
MAX_FILTER_BYTES = 32 << 20
#: Fixed values of the registered query: host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def canonical(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    found = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.char_length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    after = F.substring(rest, F.char_length(host) + 1, F.char_length(rest))
    return fold_ascii(host), F.regexp_extract(after, r"^[^?#]*", 0)


def _addresses(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and its bit positions inside the block."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    other = np.fromiter((xxhash.xxh3_64_intdigest(k, 1) for k in keys), np.uint64, len(keys))
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(8)
    bits = (other[:, None] >> shifts) & np.uint64(255)
    # 8 bits reach half of the block; the key's top bit says which half.
    half = (hashes >> np.uint64(63)) << np.uint64(8)
    return hashes % np.uint64(blocks), bits | half[:, None]


def build_filter(listed: DataFrame) -> np.ndarray:
    """The filter over column ``key``: rows are blocks. Parts are built where the keys are."""
    n = listed.count()
    blocks = min(max(1, n * BITS_PER_KEY // 8 // BLOCK_BYTES + 1), MAX_FILTER_BYTES // BLOCK_BYTES)

    def parts(batches):
        for batch in batches:
            at, bits = _addresses(as_bytes(batch.column(0)), blocks)
            places = np.unique((at[:, None] * np.uint64(BLOCK_BYTES * 8) + bits).ravel().astype(np.int64))
            yield pa.RecordBatch.from_pydict({"word": places >> 6, "bits": np.left_shift(np.int64(1), places & 63)})

    words = listed.select("key").mapInArrow(parts, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    flat = np.zeros(blocks * BLOCK_BYTES // 8, np.uint64)
    for row in words.toLocalIterator():
        flat[row["word"]] = np.uint64(row["bits"] & (1 << 64) - 1)
    return flat


def passes(keys: list[bytes], flat: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key."""
    at, bits = _addresses(keys, len(flat) * 8 // BLOCK_BYTES)
    places = (at[:, None] * np.uint64(BLOCK_BYTES * 8) + bits).astype(np.int64)
    return ((flat[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def _suffixes(host: bytes) -> list[bytes]:
    labels = host.split(b".")
    return [b".".join(labels[i:]) for i in range(len(labels))]


def filter_urls(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages``."""
    spark = pages.sparkSession
    listed = (
        rules.where("host IS NOT NULL AND path IS NOT NULL")
        .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.concat("host", F.lit("\n"), "path"))
    )
    flat = build_filter(listed)
    # Distinct prefix lengths, at most as many as a URL has characters.
    lengths = sorted(r[0] for r in listed.select(F.octet_length("path")).distinct().collect())
    shared = spark.sparkContext.broadcast((flat, lengths))

    def probe(batches):
        flat, lengths = shared.value
        for batch in batches:
            keys, owner = [], []
            for i, (host, path) in enumerate(zip(as_bytes(batch.column(1)), as_bytes(batch.column(2)))):
                starts = [path[:n] for n in lengths if n <= len(path)]
                for suffix in _suffixes(host):
                    keys += [suffix + b"\n" + start for start in starts]
                    owner += [i] * len(starts)
            hits = [[] for _ in range(batch.num_rows)]
            if keys:
                for k in np.flatnonzero(passes(keys, flat)):
                    hits[owner[k]].append(keys[k].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.list_(pa.string()))], [*names, "keys"])

    names = ["page_id", "host", "path"]
    host, path = canonical(F.col(url_column))
    kind = pages.schema[id_column].dataType.simpleString()
    probed, _ = write_table(
        pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
        .mapInArrow(probe, f"page_id {kind}, host string, path string, keys array<string>")
        .withColumn("row", F.monotonically_increasing_id()),
        "urls",
    )
    result = ["page_id", "host", "path", "rule", "verdict"]
    clear = probed.where(F.size("keys") == 0).withColumns(
        {"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")}
    )
    entry = listed.select(
        "key",
        F.struct(
            F.char_length("key").alias("length"), F.concat("host", "path").alias("rule"), "verdict"
        ).alias("entry"),
    )
    possible = (
        probed.where(F.size("keys") > 0).withColumn("key", F.explode("keys"))
        .join(entry, "key", "left")
        .groupBy("row", "page_id", "host", "path").agg(F.max("entry").alias("entry"))
        .withColumns({"rule": F.col("entry.rule"), "verdict": F.coalesce("entry.verdict", F.lit("allow"))})
    )
    return clear.select(result).unionByName(possible.select(result))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules)


SQL = """
WITH r(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM a),
p AS (SELECT row_number() OVER () AS n, page_id,
  translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM b),
m AS (SELECT p.n, p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
