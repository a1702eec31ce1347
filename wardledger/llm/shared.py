"""Helpers of the operators: words, packed arrays, written tables, shared files."""

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.session import fresh_path

#: A-Z and a-z, for the folding that touches no other letter.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` alone would fold other letters too."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of_id(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a NULL id falls in fold -1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case.

    Both methods of ``bytes`` know ASCII only: exactly ``[^\\x20\\x09-\\x0D]+``.
    """
    return text.lower().split()


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batch: pa.RecordBatch, rows: int = 512):
    """Slices of a batch, to bound what one step holds of texts and ids."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers in the narrowest width that holds them all, byte planes compressed.

    Layout: width (1 byte), number of values (8 bytes), Zstandard data of the first bytes of
    all values, then all second bytes, and so on. Small or sorted numbers shrink most.
    """
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    planes = pa.decompress(data[9:], n * width, "zstd", asbytes=True)
    return np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}")[:, 0]


class Remembered(dict):
    """Values of words, made once by ``make`` and kept while they take less than ``limit`` bytes.

    ``trim`` empties it beyond that; operators call it between batches, and ``clear`` when a task
    ends, so that a reused worker carries nothing on.
    """

    def __init__(self, make, limit: int = 16 << 20):
        super().__init__()
        self.make, self.limit, self.size = make, limit, 0

    def __missing__(self, word: bytes):
        self[word] = value = self.make(word)
        self.size += len(word) + 150
        return value

    def trim(self) -> None:
        if self.size > self.limit:
            self.clear()

    def clear(self) -> None:
        super().clear()
        self.size = 0


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values: close inputs get unrelated outputs."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written once to the shared folder, and its path for ``drop_tables``."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark itself would give it.

    A path without a scheme lies in the default file system, which tasks that open files by
    themselves would take for the local one.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


def drop_tables(spark: SparkSession, *paths: str) -> None:
    """Delete written tables whose readers have finished, and free their shuffles.

    Files of shuffles that nothing refers to any more go when the driver collects
    its garbage; a long chain of large steps asks for that here, or the shuffles of
    all its steps would lie on the executors' disks at the same time.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
    jvm.System.gc()


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def fresh_name(prefix: str) -> str:
    return f"{prefix}-{uuid.uuid4().hex}"
