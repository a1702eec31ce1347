"""What a worker takes for a block of the Jaccard join, and what packing leaves in it."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm import brute
from wardledger.llm import blocks, jaccard, packing, tokens


class _Task:
    """In place of Spark's task context."""

    get = classmethod(lambda cls: cls())

    def partitionId(self):  # noqa: N802
        return 0


def _block(monkeypatch, texts):
    monkeypatch.setattr(blocks, "TaskContext", _Task)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "held": [False] * len(texts), "text": texts})
    (block,) = blocks.blocks([batch])
    return block


def _peak(step):
    tracemalloc.start()
    try:
        result = step()
        return result, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_steps_of_a_block_hold_few_bytes_a_token(monkeypatch):
    monkeypatch.setattr(jaccard, "PORTION", 1 << 13, raising=False)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(1000)) for _ in range(300)]
    block = _block(monkeypatch, texts)
    size = 300 * 1001
    requests, most = _peak(lambda: list(jaccard._requests(4)([block])))
    assert most < 40 * size
    asked = pa.Table.from_batches(requests)
    assert asked.column("bucket").to_pylist() == [0, 1, 2, 3]
    parts = [asked.slice(i, 1) for i in range(4)]
    answers = pa.concat_tables([jaccard._counted(p) for p in parts])
    sets, most = _peak(lambda: jaccard._sets(4)(pa.Table.from_batches([block]), answers))
    assert most < 50 * size
    assert sets.column("n_shingles").to_pylist() == [len(brute.shingle_set(t)) for t in texts]


def test_portions_of_any_size_give_the_same_sets(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 3, 40, 0, 0, 7, 5, 4, 200, 1, 0)] * 3
    texts[3] = None
    block = _block(monkeypatch, texts)
    tables = []
    for portion in (1, 50, 1 << 20):
        monkeypatch.setattr(jaccard, "PORTION", portion)
        asked = pa.Table.from_batches(jaccard._requests(3)([block]))
        answers = pa.concat_tables([jaccard._counted(asked.slice(i, 1)) for i in range(len(asked))])
        tables.append(jaccard._sets(3)(pa.Table.from_batches([block]), answers).to_pylist())
    assert tables[0] == tables[1] == tables[2]
    assert [r["n_shingles"] for r in tables[0]] == [len(brute.shingle_set(t or "")) for t in texts]


def test_blocks_without_a_shingle(monkeypatch):
    block = _block(monkeypatch, [None, " "])
    (asked,) = jaccard._requests(3)([block])
    assert asked.num_rows == 0
    answers = pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
    assert jaccard._sets(3)(pa.Table.from_batches([block]), answers).column("n_shingles").to_pylist() == [0, 0]


def test_counts_are_summed_over_blocks():
    keys = [np.array([1, 5, 1 << 31], "<u4"), np.array([5, 7, 1 << 31, (1 << 32) - 1], "<u4")]
    counts = [np.array([1, 2, 3]), np.array([4, 5, 60000, 1])]
    group = pa.table({
        "bucket": [0, 0], "block": [8, 9],
        "keys": pa.array([k.tobytes() for k in keys], pa.binary()), "counts": pa.array([jaccard.pack(c) for c in counts], pa.binary()),
    })
    got = {r["block"]: jaccard.unpack(r["counts"]).tolist() for r in jaccard._counted(group).to_pylist()}
    assert got == {8: [1, 6, 60003], 9: [6, 5, 60003, 1]}


def test_packing_leaves_no_words_in_a_worker():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words", "more words"]})
    run = packing._pieces(tokens.BYTE_BPE, 8, False, tokens.REMEMBER, False)
    assert sum(b.num_rows for b in run([batch])) == 2
    encoder = tokens.Encoder.of(tokens.BYTE_BPE)
    assert not encoder.known and not encoder.before and encoder.held == 0
    assert sum(b.num_rows for b in packing._pieces(tokens.BYTE_BPE, 8, False, tokens.REMEMBER, True)([batch])) == 2
    assert encoder.known
    encoder.forget()
