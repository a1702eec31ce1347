"""Benchmark passages in documents: SimHash windows of the items' sizes, then exact similarity.

A document is read in windows as long as an item, in words. Each window has a 64-bit SimHash
of its 5-word shingles, weighted by how often each occurs in it. Two fingerprints within
``RADIUS`` bits agree in full in at least one of ``RADIUS + 1`` blocks of bits, so a table
for each block finds every item within the radius (a multi-index; the Hamming distance is
then checked). Candidates are verified by the exact weighted Jaccard similarity of the
shingles, 0.8 or more.

The multi-index finds every pair within the radius. The radius alone would lose some of
similarity 0.8: 16 bits of 64 are the angle of a cosine of 0.71, while windows of similarity 0.8
have a cosine of 0.89 or 9.7 bits on average, but a few in a thousand are farther. After the
multi-index a window is therefore also verified with the items *beyond* the radius that have one
of its rare shingles: a window of weight T and an item of similarity 0.8 share a weight of 0.8 T,
so of any shingles that weigh more than 0.2 T together they have one in common. Both parts
together lose nothing, and no pair belongs to both. ``beyond=False`` leaves the second part out.

Windows are only built where they can pass: a similarity of 0.8 needs a common shingle, so a
window starts where a shingle of the document stands in an item of its size, at the place
that aligns both. That is one membership test for each word and loses nothing; every other
window would fail the exact test.

The index of the items is the only thing every task holds. It is built from slices of items of
about ``MAX_INDEX_BYTES``; a larger benchmark takes one pass over the documents for each slice,
and what a pass found is written before the next begins, so that a task holds one index at a
time. A single item is not cut. Documents are never shuffled, however common a passage is.

Defined results: NULL texts are empty; items or documents without words match nothing; an
item of fewer than five words is one shingle, its whole sequence, and is found at any place;
rows with equal ids are judged each on its own; repeated items are reported by each of their
ids; without items nothing is contaminated; an empty table gives an empty result.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.jaccard import FACTOR, SHINGLE
from wardledger.llm.shared import Remembered, as_bytes, mix, table, words, write_table

RADIUS = 16
SIMILARITY = 0.8
BITS = 64
#: Bytes of an index in one process, and what a word of an item takes there: 620 were measured
#: for 200,000 different words.
MAX_INDEX_BYTES = 256 << 20
BYTES_A_WORD = 640
MAX_ITEM_WORDS = MAX_INDEX_BYTES // BYTES_A_WORD
#: Bit positions of each block of the multi-index.
BLOCKS = np.array_split(np.arange(BITS, dtype=np.uint64), RADIUS + 1)


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    keys = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(size):
        keys = keys * FACTOR + hashes[k : k + len(keys)]
    return mix(keys + np.uint64(size))


def _weights(hashes: np.ndarray) -> Counter:
    """Weighted shingles of a window or item."""
    if not len(hashes):
        return Counter()
    return Counter(_grams(hashes, min(SHINGLE, len(hashes))).tolist())


def simhash(weights: Counter) -> int:
    keys = np.fromiter(weights.keys(), np.uint64, len(weights))
    times = np.fromiter(weights.values(), np.int64, len(weights))
    bits = (mix(keys)[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    votes = ((bits.astype(np.int64) * 2 - 1) * times[:, None]).sum(axis=0)
    return int(sum(1 << i for i in np.flatnonzero(votes > 0).tolist()))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over the larger weights."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    either = sum(a.values()) + sum(b.values()) - both
    return both / either if either else 0.0


def block_keys(fingerprint: int) -> list[tuple[int, int]]:
    return [
        (i, (fingerprint >> int(block[0])) & ((1 << len(block)) - 1)) for i, block in enumerate(BLOCKS)
    ]


class Index:
    """Items of a slice: fingerprints by blocks of bits, and where their shingles stand."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in items]
        hashed = [_hashes(words(t)) for _, t in items]
        self.weights = [_weights(h) for h in hashed]
        self.prints = [simhash(w) for w in self.weights]
        self.sizes = [len(h) for h in hashed]
        self.multi: dict[tuple[int, int], list[int]] = {}
        self.totals = [sum(w.values()) for w in self.weights]
        self.holders: dict[int, list[int]] = {}
        anchors: dict[int, dict[int, set]] = {}
        for k, h in enumerate(hashed):
            for key in block_keys(self.prints[k]):
                self.multi.setdefault(key, []).append(k)
            for gram in self.weights[k]:
                self.holders.setdefault(gram, []).append(k)
            size = min(SHINGLE, len(h))
            for at, gram in enumerate(_grams(h, size).tolist()):
                anchors.setdefault(size, {}).setdefault(gram, set()).add((len(h), at))
        self.anchors = {
            size: (np.array(sorted(found), np.uint64), found) for size, found in anchors.items()
        }

    def near(self, fingerprint: int):
        """Items within the radius, with their distance."""
        candidates = {k for key in block_keys(fingerprint) for k in self.multi.get(key, ())}
        for k in sorted(candidates):
            distance = (self.prints[k] ^ fingerprint).bit_count()
            if distance <= RADIUS:
                yield k, distance

    def sharing(self, weights: Counter) -> set[int]:
        """Items that share enough of a window's rare shingles to be similar to it; see above."""
        total = sum(weights.values())
        # A millionth keeps rounding from losing a boundary item; the exact test follows.
        least = (SIMILARITY - 1e-6) * total
        held = sorted((len(self.holders[g]), g) for g in weights if g in self.holders)
        rest = sum(weights[g] for _, g in held)
        found: set[int] = set()
        for _, gram in held:
            if rest < least:
                break
            found.update(self.holders[gram])
            rest -= weights[gram]
        return {k for k in found if least <= self.totals[k] and (SIMILARITY - 1e-6) * self.totals[k] <= total}

    def windows(self, hashes: np.ndarray):
        """(start, size) of the windows that share an aligned shingle with an item."""
        found = set()
        for size, (keys, places) in self.anchors.items():
            grams = _grams(hashes, size)
            at = np.searchsorted(keys, grams)
            at[at == len(keys)] = 0
            for i in np.flatnonzero(keys[at] == grams).tolist():
                for length, offset in places[int(grams[i])]:
                    start = max(0, min(i - offset, len(hashes) - length))
                    found.add((start, length))
        return sorted(found)

    def far(self, fingerprint: int, weights: Counter):
        """Items beyond the radius that can be similar all the same, with their distance."""
        for k in self.sharing(weights):
            distance = (self.prints[k] ^ fingerprint).bit_count()
            if distance > RADIUS:
                yield k, distance

    def spans(self, hashes: np.ndarray, beyond: bool = True):
        """(item_id, start, size, distance, similarity) of the passages in a document."""
        for start, size in self.windows(hashes):
            weights = _weights(hashes[start : start + size])
            fingerprint = simhash(weights)
            found = dict(self.near(fingerprint))
            if beyond:
                found.update(self.far(fingerprint, weights))
            for k, distance in sorted(found.items()):
                alike = similarity(weights, self.weights[k])
                if alike >= SIMILARITY:
                    yield self.ids[k], start, size, distance, alike


_known = Remembered(xxhash.xxh3_64_intdigest)


def _hashes(own: list[bytes]) -> np.ndarray:
    _known.trim()
    return np.fromiter(map(_known.__getitem__, own), np.uint64, len(own))


SPAN = "array<struct<item_id:long,start:long,words:long,distance:int,similarity:double>>"


def _judge(index, last):
    """Add the passages of one slice of items to ``__spans``; the last pass leaves the text out."""

    def run(batches):
        for batch in batches:
            spans = [
                (before or []) + [dict(zip(SPAN_FIELDS, s)) for s in index.value.spans(_hashes(words(text)))]
                for before, text in zip(batch.column("__spans").to_pylist(), as_bytes(batch.column("__text")))
            ]
            rest = batch.drop_columns(["__spans", "__text"] if last else ["__spans"])
            yield pa.RecordBatch.from_arrays(
                [*rest.columns, pa.array(spans, _SPAN_ARROW)], [*rest.schema.names, "__spans"]
            )
        _known.clear()

    return run


SPAN_FIELDS = ("item_id", "start", "words", "distance", "similarity")
_SPAN_ARROW = pa.list_(pa.struct({
    "item_id": pa.int64(), "start": pa.int64(), "words": pa.int64(), "distance": pa.int32(), "similarity": pa.float64()
}))


def contaminated_spans(docs: DataFrame, items: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every document and ``spans``: its passages of ``items`` (item_id, text)."""
    spark = docs.sparkSession
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    n_words = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    slices = max(1, math.ceil(n_words / MAX_ITEM_WORDS))
    part = F.pmod(F.xxhash64("item_id"), F.lit(slices))
    out = docs.select(*columns, F.col("text").alias("__text"), F.array().cast(SPAN).alias("__spans"))
    for k in range(slices):
        own = items.where(part == k).select("item_id", "text").collect()  # at most MAX_ITEM_WORDS words
        index = spark.sparkContext.broadcast(Index([(r[0], (r[1] or "").encode()) for r in own]))
        last = k == slices - 1
        kept = [f for f in out.schema.fields if f.name != "__spans" and not (last and f.name == "__text")]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        out = out.mapInArrow(_judge(index, last), f"{fields}, __spans {SPAN}")
        if not last:
            out, _ = write_table(out, "contaminated")
            index.unpersist()
    return out.select(*columns, F.col("__spans").alias("spans"))


def judge_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, n_passages and best_similarity of every row."""
    found = F.col("spans")
    return contaminated_spans(docs, items, ["doc_id"]).select(
        "doc_id",
        (F.size(found) > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(found["item_id"])).alias("item_ids"),
        F.size(found).cast("long").alias("n_passages"),
        F.coalesce(F.array_max(found["similarity"]), F.lit(0.0)).alias("best_similarity"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, with all their columns.

    A row travels with its own verdict, so no join is needed.
    """
    names = {name: f"__c{i}" for i, name in enumerate(docs.columns)}
    moved = docs.withColumnsRenamed(names).withColumn("text", F.col(names["text"]))
    kept = contaminated_spans(moved, items, list(names.values())).where(F.size("spans") == 0)
    return kept.select(*(F.col(new).alias(old) for old, new in names.items()))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
