"""Contexts that are split over buckets."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import prose
from wardledger.llm import lm, shared

U = 5


def rows():
    """Two buckets that hold one context's dishes, and one of its own each."""
    rng = np.random.default_rng(3)
    for number in (0, 1):
        own = np.sort(rng.choice(400, 60, replace=False)) * 2 + number
        yield {
            "bucket": number, "u": shared.pack(np.array([2 + number] * 3 + [U] * 60)), "w": shared.pack(np.append([0, 1, 2], own)),
            "c": shared.pack(np.append([4, 2, 0], rng.integers(1, 30, 60))),
        }


def test_probabilities_of_a_split_context_add_up_to_one():
    made = list(rows())
    customers = sum(float(shared.unpack(r["c"])[3:].sum()) for r in made)
    hot = {U: (customers, 500.0)}
    left = np.full((lm.SAMPLES, 60), 1.0, "<f4")
    parts = [
        {**r, **{k: shared.pack(shared.unpack(r[k])[3:]) for k in ("u", "w", "c")}, "left": left.tobytes(), "tables": []}
        for r in made
    ]
    theta, d, shares = 2.0, 0.5, [0.5] * lm.SAMPLES
    p = 1.5 / 180
    for k in range(len(lm.SWEEPS)):
        batch = pa.RecordBatch.from_pylist(parts)
        out = [b.to_pylist()[0] for b in lm._split_sweep(hot, k, theta, d, 180.0, shares)([batch])]
        assert [r["names"] for r in out] == [[U], [U]]
        assert [len(r["tables"]) for r in out] == [k + 1, k + 1]
        total = sum(r["totals"][0] for r in out)
        hot, parts, mass = {U: (customers, total)}, out, 0.0
        for row, r in zip(out, made):
            bucket = lm._Bucket(r, hot)
            bucket.t[bucket.split] = shared.unpack(row["tables"][k])
            assert (bucket.t[bucket.split] <= np.maximum(bucket.c[bucket.split], 0)).all()
            mass += bucket.predict(np.full(63, p), theta, d)[bucket.split].sum()
        rest = 1 - 120 * p  # words that never follow the context
        assert mass + rest * (theta + d * total) / (theta + customers) == pytest.approx(1.0)


def test_split_context_counts_once_in_the_concentration():
    whole = [lm._restaurant_log(np.array([90.0]), np.array([900.0]), x, 0.4) for x in lm.THETAS]
    assert lm._split_logs({U: (900, 90.0), 6: (5, None)}, 0.4) == pytest.approx(whole)
    assert not lm._split_logs({}, 0.4).any()


def test_corpus_with_a_split_context(spark, documents):
    import random

    rng = random.Random(4)
    docs = documents([(i, " the ".join(prose(rng, 60).split())) for i in range(30)])
    scored = lm.score_documents(docs).collect()
    assert len(scored) == 30 and all(r["score"] < 0 for r in scored)
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
