"""Similar passages whose fingerprints lie farther apart than the radius."""

import random

from tests.llm.test_operators import prose
from wardledger.llm import decontaminate
from wardledger.llm.shared import words


def edited(rng, text):
    """Words at the end replaced until the similarity is just 0.8 or more."""
    own = text.split(" ")
    keep = -(-8 * 2 * (len(own) - 4) // 18) + 4
    return " ".join(own[:keep] + [f"e{rng.randrange(10**9)}" for _ in own[keep:]])


def cases(n):
    """(item, passage, distance) with similarity 0.8 to 0.85."""
    for seed in range(n):
        rng = random.Random(seed)
        text = prose(rng, rng.randint(59, 120))
        other = edited(rng, text)
        a, b = (decontaminate._weights(decontaminate._hashes(words(t.encode()))) for t in (text, other))
        assert 0.8 <= decontaminate.similarity(a, b) < 0.85
        yield text, other, (decontaminate.simhash(a) ^ decontaminate.simhash(b)).bit_count()


def test_passages_beyond_the_radius_are_found(spark, documents):
    far = [(text, other) for text, other, distance in cases(1500) if distance > decontaminate.RADIUS]
    assert far
    items = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(far)], "item_id long, text string")
    docs = documents([(i, f"before it {t} and after") for i, (_, t) in enumerate(far)])
    found = {r["doc_id"]: r["item_ids"] for r in decontaminate.judge_documents(docs, items).collect()}
    assert found == {i: [i] for i in range(len(far))}
    assert decontaminate.drop_contaminated(docs, items).count() == 0


def test_each_window_meets_every_similar_item():
    """All items against a window by the exact similarity alone, whatever their sizes."""
    rng = random.Random(6)
    base = prose(rng, 60).split(" ")
    texts = [" ".join(base[rng.randrange(8) : 60 - rng.randrange(8)] + ["tail"] * rng.randrange(6)) for _ in range(40)]
    texts += ["a b a b a b a b a b a b", "tiny item", "", prose(rng, 30)]
    index = decontaminate.Index(list(enumerate(t.encode() for t in texts)))
    document = decontaminate._hashes(words(" ".join([*texts[:3], texts[40], "tiny item"]).encode()))
    want = []
    for start, size in index.windows(document):
        own = decontaminate._weights(document[start : start + size])
        alike = [(k, decontaminate.similarity(own, w)) for k, w in enumerate(index.weights)]
        want += [(k, start, size, a) for k, a in alike if a >= decontaminate.SIMILARITY]
    got = [(k, start, size, alike) for k, start, size, _, alike in index.spans(document)]
    assert got == want and len(got) > 40


def test_the_multi_index_finds_what_lies_within_the_radius():
    """Without the part beyond the radius just the pairs beyond it are lost, 1 % at most."""
    pairs = list(cases(600))
    index = decontaminate.Index([(i, t.encode()) for i, (t, _, _) in enumerate(pairs)])
    found = set()
    for i, (_, other, _) in enumerate(pairs):
        found |= {(i, s[0]) for s in index.spans(decontaminate._hashes(words(other.encode())), beyond=False)}
    assert found == {(i, i) for i, (_, _, distance) in enumerate(pairs) if distance <= decontaminate.RADIUS}
    assert len(found) >= 0.98 * len(pairs)


def test_the_multi_index_is_needed(monkeypatch):
    text = prose(random.Random(3), 80)
    index = decontaminate.Index([(5, text.encode())])
    document = decontaminate._hashes(words(f"before it {text} and after".encode()))
    assert [s[0] for s in index.spans(document)] == [5]
    index.multi = {}
    assert not list(index.spans(document))


def test_slices_of_items_are_passes_of_their_own(spark, documents, monkeypatch):
    texts = [prose(random.Random(s), 40) for s in range(8)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = documents([(i, f"start {texts[i]} {texts[(i + 3) % 8]}") for i in range(8)] + [(9, None), (10, "clean text")])
    whole = decontaminate.judge_documents(docs, items).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 90)
    sliced = decontaminate.judge_documents(docs, items)
    assert sliced._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sliced.orderBy("doc_id").collect() == whole
    assert [r["item_ids"] for r in whole] == [sorted({i, (i + 3) % 8}) for i in range(8)] + [[], []]


def test_no_documents(spark, documents):
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert decontaminate.judge_documents(documents([]), items).count() == 0
