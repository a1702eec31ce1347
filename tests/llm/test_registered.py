"""Registered queries on a small folder, against plain Python."""

import random

import __spark_entry__ as entry
from tests.llm.test_operators import prose
from wardledger.llm.decontaminate import SIMILARITY, similarity
from wardledger.llm.queries import QUERIES


def grams(own):
    from collections import Counter

    size = min(5, len(own))
    return Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1)) if own else Counter()


def test_decontamination_matches_every_window(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, n)) for i, n in enumerate((20, 35, 60, 3))] + [(7, None)]
    docs = [(9, None), (10, ""), (11, prose(rng, 80)), (12, items[3][1]), (None, items[1][1])]
    for i in range(30):
        own = items[i % 3][1].split(" ")
        for _ in range(i // 10):
            own[rng.randrange(len(own))] = f"new{i}"
        docs.append((100 + i, f"{prose(rng, i)} {' '.join(own)} {prose(rng, 5)}"))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = []
    for i, text in docs:
        own = (text or "").split()
        found = [
            k for k, item in items if (passage := (item or "").split())
            and any(similarity(grams(own[s : s + len(passage)]), grams(passage)) >= SIMILARITY for s in range(len(own)))
        ]
        want.append((-1 if i is None else i, bool(found), found))
    rows = QUERIES["op5_benchmark_decontamination"](spark, str(tmp_path)).collect()
    got = [(-1 if r["doc_id"] is None else r["doc_id"], r["contaminated"], r["item_ids"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert 0 < sum(c for _, c, _ in want) < len(docs)


def test_first_stage_of_the_pipeline_drops_what_the_classifier_rejects(spark, tmp_path):
    rng = random.Random(4)
    docs = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(6))) for i in range(200)]
    docs += [(200 + i, prose(rng, 60).upper().replace(" ", "!! ")) for i in range(100)]
    rows = [(i, t, "en", "s", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 200), 0) for i, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, docs[3][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    judged = QUERIES["op8_quality_classifier"](spark, str(tmp_path)).collect()
    good = {r["doc_id"] for r in judged if r["predicted"]}
    assert len(good ^ set(range(200))) <= 9 and 3 in good
    # All texts differ, and one of them is the benchmark's.
    assert {r["doc_id"] for r in entry.queries()["pipeline"](spark, str(tmp_path)).collect()} == good - {3}
