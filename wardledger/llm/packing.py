"""Best-two-fit packing of token ids into sequences of bounded length.

Only documents longer than a sequence are cut: into full sequences, the piece left over
being the first. Pieces are dealt at random (by hash) into groups of about ``GROUP``
pieces; a group is packed inside a task by lengths alone, so a task holds a count for each
length and one queue of piece numbers for each, never tokens. With thousands of pieces in a
group, all groups together lose about one sequence each against one big group, or 0.01 %.

Best-two-fit: a bin is filled greedily, the longest piece that fits first. If a gap is left,
its smallest piece is taken out and the two unpacked pieces whose lengths together fill the
widened gap most tightly replace it, if they fill it better.

Defined results: NULL text is empty, and an empty document is the end id alone; every row
yields its pieces, also where ids repeat or are NULL; equal lengths are taken in the order
of the piece numbers; an empty table gives an empty result.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import as_bytes, table, write_table
from wardledger.llm.tokens import BYTE_BPE, REMEMBER, Encoder, small_batches

LENGTH = 2048
GROUP = 1 << 14
END_ID = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    first = n % length or length
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def _pieces(tokenizer, length, with_ids, remember, keep):
    def run(batches):
        encoder = Encoder.of(tokenizer, remember=remember)
        for batch in batches:
            for part in small_batches(batch):
                rows = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
                for doc, ids in zip(part.column(0).to_pylist(), encoder.ids(as_bytes(part.column(1)))):
                    ids += END_ID.to_bytes(4, "little")
                    for k, (start, n) in enumerate(cuts(len(ids) // 4, length)):
                        own = ids[4 * start : 4 * (start + n)]
                        for name, value in zip(rows, (doc, k, start, n, zlib.crc32(own), own)):
                            rows[name].append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(v, t) for v, t in zip(rows.values(), kinds)]
                m = len(arrays) if with_ids else len(arrays) - 1
                yield pa.RecordBatch.from_arrays(arrays[:m], list(rows)[:m])
        if not keep:
            encoder.forget()

    return run


def best_two_fit(lengths: np.ndarray, length: int) -> list[list[int]]:
    """Bins of piece numbers; every piece has 1 to ``length`` ids."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    queues: list[list[int]] = [[] for _ in range(length + 1)]
    for i in order[::-1].tolist():
        queues[int(lengths[i])].append(i)
    there = 0  # bit n: some unpacked piece has n ids
    for n, queue in enumerate(queues):
        if queue:
            there |= 1 << n

    def longest(room: int) -> int:
        return (there & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 else -1

    def take(n: int) -> int:
        nonlocal there
        piece = queues[n].pop()
        if not queues[n]:
            there &= ~(1 << n)
        return piece

    bins = []
    while there:
        gap, held = length, []
        while (n := longest(gap)) > 0:
            held.append((n, take(n)))
            gap -= n
        if gap and len(held) > 1:
            smallest, piece = held[-1]
            room, best = gap + smallest, (smallest, 0, 0)
            a = longest(room - 1)
            while a > 0 and 2 * a >= best[0]:
                b = longest(min(a, room - a))
                if b == a and len(queues[a]) < 2:
                    b = longest(min(a - 1, room - a))
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = longest(a - 1)
            if best[0] > smallest:
                queues[smallest].append(piece)
                there |= 1 << smallest
                held[-1:] = [(n, take(n)) for n in best[1:]]
        bins.append([piece for _, piece in held])
    return bins


def _pack(length):
    def run(group: pa.Table) -> pa.Table:
        order = group.select(["doc_id", "piece", "ids_crc32"]).to_pandas().sort_values(
            ["doc_id", "piece", "ids_crc32"], kind="stable"
        ).index.to_numpy()
        group = group.take(pa.array(order))
        lengths = group.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        number = group.column("group")[0].as_py() << 32
        for k, pieces in enumerate(best_two_fit(lengths, length)):
            sequence[pieces] = number + k
            offset[pieces] = np.cumsum(lengths[pieces]) - lengths[pieces]
        return group.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, length: int = LENGTH, tokenizer: str = BYTE_BPE, with_ids: bool = False, remember: int = REMEMBER, keep: bool = False) -> DataFrame:
    """Every piece with its sequence and place; with its ids as 32-bit integers if asked for.

    ``remember`` bounds each of the two generations of encoded words that a worker keeps, in bytes;
    they go when a task ends, unless ``keep`` lets its next task have them.
    """
    fields = PIECE + (", ids binary" if with_ids else "")
    text = F.coalesce("text", F.lit(""))
    pieces, _ = write_table(
        docs.select("doc_id", text).mapInArrow(_pieces(tokenizer, length, with_ids, remember, keep), fields), "pieces"
    )
    groups = max(1, pieces.count() // GROUP)
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_pack(length), f"{fields}, sequence_id long, offset long")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Nothing else runs beside it, so its words may take more room than in the pipeline.
    return pack_documents(table(spark, sf_dir, "documents"), remember=144 << 20, keep=True)
