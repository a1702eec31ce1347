"""Sweeps of the language model follow each other."""

import numpy as np
import pyarrow as pa
import pytest

from wardledger.llm import lm, shared


def test_sweeps_of_the_parent_see_the_totals_of_all_its_buckets(spark):
    rng = np.random.default_rng(5)
    words = np.arange(400)
    sent = spark.createDataFrame(
        [(b % 2, b, shared.pack(words[words % 2 == b % 2]), shared.pack(rng.integers(1, 60, 200))) for b in range(4)],
        "parent long, bucket long, w binary, customers binary",
    )
    totals = lm._parent_totals(sent, 0.6, 1.0, 1 / 401, 400)
    assert len(totals) == lm.SAMPLES + 1 and totals[0] == 400 and len(set(totals)) == len(totals)
    answers = sent.groupBy("parent").applyInArrow(lm._parent(0.6, 1.0, 1 / 401, totals), lm.FROM_PARENT).collect()
    # The total that a sweep started from is what the sweep before has left.
    for s in range(lm.SAMPLES - 1):
        assert sum(r["tables"][s] for r in answers) == totals[s + 2]


def test_the_first_sweep_of_the_leaves_is_not_averaged():
    w = np.arange(30)
    c = np.random.default_rng(1).integers(1, 40, 30)
    seats = {"bucket": 0, "u": shared.pack(np.full(30, 7)), "w": shared.pack(w), "c": shared.pack(c), "base": None, "blocks": [0]}
    piece = {k: shared.pack(v) for k, v in {
        "at": np.diff(w, prepend=0), "entries": np.ones(30, int), "docs": w, "times": np.ones(30, int)}.items()}
    row = {**seats, "pieces": [piece]}
    left = pa.Table.from_pylist([row])
    samples = np.random.default_rng(2).random((lm.SAMPLES, 30)).astype("<f4")
    right = pa.table({"parent": [0], "left": [samples.tobytes()], "tables": pa.array([None], pa.list_(pa.binary()))})
    theta, d, customers, shares = 2.0, 0.5, 31.0, [0.1] * lm.SAMPLES
    out = lm._scores(1, {}, theta, d, customers, shares, [{}] * len(lm.SWEEPS))(left, right)
    bucket, rng, mean = lm._Bucket(seats, {}), np.random.default_rng([3, 0]), 0.0
    for k, s in enumerate([0, *range(lm.SAMPLES)]):
        p = (samples[s].astype(float) + shares[s]) / customers
        bucket.sweep(rng, p, theta, d)
        mean = mean + bucket.predict(p, theta, d) if k else 0.0
    got = shared.unpack(out.column("part")[0].as_py()) / -lm.UNIT
    assert got == pytest.approx(np.log10(mean / lm.SAMPLES), abs=1e-7)
