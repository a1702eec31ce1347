"""Documents packed into blocks of tokens, the unit in which corpus statistics are dealt out.

A block holds whole documents of one input partition, about ``BLOCK`` tokens in all. Its
tokens are numbers of its own distinct words in order of first sight; the words' 64-bit
hashes come along in ascending order, with the number of each. What a block
asks of, or sends to, a bucket of a corpus-wide table is one packed row for each bucket,
with every key once: a key that fills a third of the corpus costs one entry for each block.
"""

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext

from wardledger.llm.shared import as_bytes, pack, small_batches, words

BLOCK = 1 << 21


def blocks(batches):
    """Rows (doc_id, held, text) as blocks: tokens are numbers of the block's own words."""
    ids, held, lengths, tokens = [], [], [], []
    names = None
    part, number, size = TaskContext.get().partitionId(), 0, 0

    def block():
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
        order = np.argsort(hashes)
        return pa.RecordBatch.from_pydict({
            "block": [(part << 32) + number],
            "ids": pa.array([ids], pa.list_(pa.int64())),
            "held": pa.array([held], pa.list_(pa.bool_())),
            "lengths": [pack(np.array(lengths))],
            "tokens": [pack(np.concatenate(tokens))],
            "hashes": [pack(hashes[order])],
            "numbers": [pack(order)],
            "trained": [sum(n for n, h in zip(lengths, held) if not h)],
            "documents": [len(held) - sum(held)],
        })

    for batch in (part for whole in batches for part in small_batches(whole)):
        for doc, out, text in zip(
            batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
        ):
            if names is None:
                names = dict.fromkeys([b""], 0)
                counter = itertools.count(1)
                known = _Numbers(names, counter)
            own = words(text)
            own.append(b"")  # the end: no word is empty
            tokens.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
            names = known
            ids.append(doc)
            held.append(out)
            lengths.append(len(own))
            size += len(own)
            if size >= BLOCK:
                yield block()
                ids, held, lengths, tokens = [], [], [], []
                names, number, size = None, number + 1, 0
    if ids:
        yield block()


class _Numbers(dict):
    """Word -> number in order of first sight."""

    def __init__(self, start, counter):
        super().__init__(start)
        self.counter = counter

    def __missing__(self, word):
        self[word] = number = next(self.counter)
        return number


BLOCKS = (
    "block long, ids array<long>, held array<boolean>, lengths binary, tokens binary, "
    "hashes binary, numbers binary, trained long, documents long"
)


def range_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each hash: equal ranges of the 64-bit numbers, so ascending hashes give ascending buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray):
    """Stable order by bucket, and (bucket, from, to) of each."""
    order = np.argsort(bucket, kind="stable")
    found, start = np.unique(bucket[order], return_index=True)
    return order, list(zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(bucket)]))


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    change = np.zeros(len(sorted_keys[0]), bool)
    change[:1] = True
    for key in sorted_keys:
        change[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(change)
