"""Token ids as flat binary shards with 64-bit document offsets.

A shard is two files. ``<name>.bin`` holds the ids of its documents one after the other,
as unsigned 16-bit integers where the vocabulary allows it and 32-bit ones otherwise,
little-endian. ``<name>.idx`` holds one unsigned 64-bit number more than the shard has
documents: where each begins, in ids from the start of the shard, and the end. Shards are
ranges of doc_id in ascending order; the number of ids before a shard (its *base*) is the
prefix sum over the shards before it, one number for each partition.

Tasks write through the file system that the URI of the folder names. A file name is new
for each attempt and only the manifest, built from the attempts that succeeded, tells which
files count; what a lost attempt left is never read. Readers map the files into memory on a
local or mounted file system.

Defined results: NULL text is empty, and an empty text is the end id alone; a NULL doc_id
comes first; rows with equal ids follow each other in the order of their texts' hashes; an
empty table gives no shard and an empty result.
"""

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import as_bytes, fresh_path, qualified, shuffle_partitions, table
from wardledger.llm.tokens import BYTE_BPE, Encoder, small_batches

END_ID = 0
END = END_ID.to_bytes(4, "little")
#: Ids that a reader widens at once, unless one document has more.
READ_IDS = 1 << 20
READ_DOCS = 4096
#: Bytes of encoded words in each of the two generations that a writing task keeps.
REMEMBER = 144 << 20
MANIFEST = "shard int, name string, width int, docs long, ids long"


def _place(folder: str):
    """File system and path of a qualified folder."""
    from pyarrow import fs

    local = folder.startswith("file:") and not folder.startswith("file://")
    return fs.FileSystem.from_uri(folder.replace("file:", "file://", 1) if local else folder)


def _write(folder, tokenizer):
    """A sorted range (doc_id, text) as one shard; returns its manifest row."""

    def run(batches):
        encoder = Encoder.of(tokenizer, remember=REMEMBER)
        width = 2 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else 4
        system, path = _place(folder)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        lengths, out, ids_of_docs = [], None, []
        for batch in batches:
            for part in small_batches(batch):
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.bin")
                own = encoder.ids(as_bytes(part.column(1)))
                joined = END.join([*own, b""])  # the end id stands after each document
                out.write(np.frombuffer(joined, "<u4").astype(f"<u{width}"))
                lengths.extend(len(ids) // 4 + 1 for ids in own)
                ids_of_docs.append(part.column(0))
        if out is None:
            return
        out.close()
        offsets = np.append(0, np.cumsum(np.array(lengths, np.int64))).astype("<u8")
        with system.open_output_stream(f"{path}/{name}.idx") as index:
            index.write(offsets.tobytes())
        with system.open_output_stream(f"{path}/{name}.ids") as index:
            both = pa.chunked_array(ids_of_docs).combine_chunks()
            index.write(np.asarray(both.is_valid()).astype("u1").tobytes())
            index.write(np.asarray(both.fill_null(0)).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([name]), pa.array([width], pa.int32()),
                pa.array([len(lengths)], pa.int64()), pa.array([int(offsets[-1])], pa.int64()),
            ],
            ["shard", "name", "width", "docs", "ids"],
        )

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str = BYTE_BPE) -> DataFrame:
    """Write ``docs`` as shards under ``folder`` and return the manifest with each base.

    The manifest, one row for each shard, is a table in ``folder``/manifest.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder)
    text = F.coalesce("text", F.lit(""))
    parts = (
        docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    )
    written = parts.mapInArrow(_write(folder, tokenizer), MANIFEST).collect()  # one row a partition
    base, rows = 0, []
    for r in sorted(written):
        rows.append((*r, base))
        base += r["ids"]
    manifest = spark.createDataFrame(rows, f"{MANIFEST}, base long")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(f"{MANIFEST}, base long").parquet(f"{folder}/manifest")


def _map(system, path: str, dtype: str) -> np.ndarray:
    """A file as an array, mapped into memory where the file system is local."""
    from pyarrow import fs

    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return np.frombuffer(file.read_buffer(), dtype)
    with system.open_input_file(path) as file:
        return np.frombuffer(file.read_buffer(), dtype)


def _read(folder):
    def run(batches):
        system, path = _place(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ids = _map(system, f"{path}/{r['name']}.bin", f"<u{r['width']}")
                offsets = _map(system, f"{path}/{r['name']}.idx", "<u8").astype(np.int64)
                raw = _map(system, f"{path}/{r['name']}.ids", "u1")
                valid, names = raw[: r["docs"]].astype(bool), raw[r["docs"] :].view("<i8")
                at = 0
                while at < r["docs"]:
                    to = int(np.searchsorted(offsets, offsets[at] + READ_IDS, "right")) - 1
                    to = min(max(to, at + 1), at + READ_DOCS, r["docs"])
                    wide = memoryview(ids[offsets[at] : offsets[to]].astype("<u4")).cast("B")
                    ends = ((offsets[at : to + 1] - offsets[at]) * 4).tolist()
                    sums = [zlib.crc32(wide[a:b]) for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(names[at:to], pa.int64(), mask=~valid[at:to]),
                            pa.array(offsets[at:to] + r["base"], pa.int64()),
                            pa.array(np.diff(offsets[at : to + 1]), pa.int64()),
                            pa.array(sums, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    at = to

    return run


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""
    n = max(1, manifest.count())
    folder = qualified(manifest.sparkSession, folder)
    return manifest.repartitionByRange(n, "shard").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op9_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-ids")
    return read_shards(write_shards(table(spark, sf_dir, "documents"), folder), folder)
