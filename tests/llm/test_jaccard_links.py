"""All links of the Jaccard join, not only those that connect."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_operators import WORDS, collected, prose
from wardledger.llm import jaccard
from wardledger.llm.queries import QUERIES


def family(rng, n):
    """A chain (each text differs a little from the one before) and a ball round one text."""
    own = prose(rng, 100).split(" ")
    out = []
    for i in range(n):
        out.append((i, " ".join(own)))
        own[rng.randrange(100)] = f"chain{i}"
    base = prose(rng, 100).split(" ")
    for i in range(n, 2 * n):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(100)] = rng.choice(WORDS)
        out.append((i, " ".join(own)))
    return out


@pytest.mark.parametrize("small, shingles", [(512, 1 << 20), (5, 1 << 20), (512, 500)])
def test_no_link_is_left_out(spark, documents, tmp_path, monkeypatch, small, shingles):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles)
    rng = random.Random(4)
    docs = family(rng, 20)
    pair = prose(rng, 80)
    docs += [(90, pair), (91, pair + " end"), (92, pair), (93, ""), (94, None), (95, prose(rng, 30)), (None, pair)]
    documents(docs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op2_jaccard_join"](spark, str(tmp_path))
    want = brute.jaccard_links(docs)
    assert collected(rows, "doc_id", "n_links") == want
    assert max(n for _, n in want) > 2
    assert collected(rows, "doc_id", "n_shingles", "component_id") == brute.jaccard_components(docs)


def test_overlaps_are_those_of_sets():
    rng = np.random.default_rng(2)
    sets = [set(range(40)) | set(rng.integers(0, 400, 30).tolist()) for _ in range(25)] + [set()]
    packed = [np.array(sorted(s), np.uint64).tobytes() for s in sets]
    got = jaccard.overlaps(packed[:10], packed[10:], columns=16, most=50)
    assert got.tolist() == [[len(a & b) for b in sets[10:]] for a in sets[:10]]
