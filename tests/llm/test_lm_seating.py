"""Seating of many customers at once against the exact distribution of the number of tables."""

import numpy as np
import pytest

from wardledger.llm import lm


def exact_mean(c, others, p, d):
    """Mean number of tables of a dish: every customer joins a table or opens one, all ways weighed."""
    t = np.arange(1, c + 1, dtype=float)
    logs = np.full(c, -np.inf)
    logs[0] = 0.0
    opens = np.log((others + d * t[:-1]) * p)
    for n in range(1, c):
        stay = np.where(t <= n, logs + np.log(np.maximum(n - d * t, 1e-12)), -np.inf)
        stay[1:] = np.logaddexp(stay[1:], logs[:-1] + opens)
        logs = stay
    weights = np.exp(logs - logs.max())
    return float((weights * t).sum() / weights.sum())


@pytest.mark.parametrize("c", [5, 60, 70, 400, 1500])
@pytest.mark.parametrize("others,p", [(3.0, 0.01), (300.0, 0.05), (2000.0, 0.2)])
def test_number_of_tables(c, others, p):
    n, d = 4000, 0.7
    t = lm.reseat(np.random.default_rng(c), np.full(n, float(c)), np.full(n, others), np.full(n, p), d)
    assert t.min() >= 1 and t.max() <= c
    mean = exact_mean(c, others, p, d)
    assert abs(t.mean() - mean) <= 4 * t.std() / np.sqrt(n) + (1e-9 if c <= lm.EXACT else 0.035 * mean)


def test_steps_grow_with_the_logarithm_of_a_dish():
    class Counted:
        def __init__(self):
            self.rng, self.calls = np.random.default_rng(1), 0

        def binomial(self, n, p):
            self.calls += 1
            return self.rng.binomial(n, p)

    rng = Counted()
    t, _ = lm._seat_many(rng, np.array([1e7, 1e2]), np.full(2, 1e5), np.full(2, 0.1), 0.8)
    assert rng.calls < 300 and t[0] > 10_000 and t[1] <= 100


def test_scores_hardly_depend_on_the_layout(spark):
    """Held-out texts beat the base, and other partitions only change the draws."""
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    scores = []
    try:
        for partitions in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = lm.op1_lm_scoring(spark, "/root/testdata/sf0.001").collect()
            held = [r for r in rows if r["held_out"]]
            assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
            scores.append({r["doc_id"]: r["score"] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    first, second = scores
    assert first.keys() == second.keys()
    for doc_id, score in first.items():
        assert second[doc_id] == pytest.approx(score, rel=0.05)
