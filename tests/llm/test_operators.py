"""Every operator against plain Python on small inputs with awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from wardledger.llm import binary, components, decontaminate, exact, jaccard, lines, lm, packing, quality, shared, tokens, urls

WORDS = [f"w{i}" for i in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def items():
    """Copies, near copies, short and empty texts, NULLs and one very long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(25)]
    out = list(enumerate(base))
    for i, text in enumerate(base[:12]):
        own = text.split(" ")
        own[len(own) // 2] = "changed"
        out += [(100 + i, text), (200 + i, text.upper()), (300 + i, " ".join(own)), (400 + i, text + "\nshared line\nend")]
    out += [(500, ""), (501, None), (502, "  \n "), (503, "one two"), (504, "One  two"), (505, "É ß"), (506, "\n\n")]
    out += [(507, prose(rng, 20000)), (508, "shared line"), (None, "shared line"), (None, None)]
    out += [(600 + i, f"Shared Line \n{prose(rng, 8)}") for i in range(10)]
    return out


def collected(df, *columns):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*columns).collect())


def test_language_model_counts_and_base(documents, items):
    got = {r["doc_id"]: r for r in lm.score_documents(documents([x for x in items if x[0] is not None])).collect()}
    want = brute.lm_base([x for x in items if x[0] is not None])
    assert len(got) == len(want)
    for i, out, n, known, total, base in want:
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_language_model_beats_base_on_held_out_text_with_structure(documents):
    rng = random.Random(1)
    follow = {w: rng.sample(WORDS, 3) for w in WORDS}

    def chain():
        own = [rng.choice(WORDS)]
        for _ in range(60):
            own.append(rng.choice(follow[own[-1]]))
        return " ".join(own)

    rows = lm.score_documents(documents([(i, chain()) for i in range(200)])).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.7 * sum(r["base_score"] for r in rows)


def test_probabilities_of_a_context_add_up_to_one():
    u = np.array([5] * 4)
    row = {"u": shared.pack(u), "w": shared.pack(np.arange(4)), "c": shared.pack(np.array([7, 3, 1, 0]))}
    bucket = lm._Bucket(row, {})
    p = np.array([0.4, 0.3, 0.2, 0.1])
    bucket.sweep(np.random.default_rng(0), p, 1.5, 0.6)
    assert np.all(bucket.t <= np.maximum(bucket.c, 0)) and np.all(bucket.t[:3] >= 1)
    assert bucket.predict(p, 1.5, 0.6).sum() == pytest.approx(1.0)


def test_seating_follows_the_exact_distribution():
    """Three customers: P(t) is known; the draws agree with it."""
    theta, d, p = 1.0, 0.5, 0.2
    rise = lambda t: np.prod([(theta + d * k) * p for k in range(1, t)])
    ways = {1: (1 - d) * (2 - d), 2: 3 * (1 - d), 3: 1.0}
    weight = np.array([ways[t] * rise(t) for t in (1, 2, 3)])
    n = 40000
    t = lm.reseat(np.random.default_rng(1), np.full(n, 3.0), np.full(n, theta), np.full(n, p), d, draws=6)
    found = np.bincount(t.astype(int), minlength=4)[1:] / n
    assert np.abs(found - weight / weight.sum()).max() < 0.01


def test_long_dishes_are_seated_at_once():
    c = np.array([10.0, 1e4, 1e9])
    t = lm.reseat(np.random.default_rng(1), c, np.full(3, 2.0), np.full(3, 0.01), 0.5)
    assert np.all((t >= 1) & (t <= c))


def test_jaccard_components(documents, items):
    got = collected(jaccard.similarity_components(documents(items)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(items)


def test_jaccard_large_region_goes_through_pivots(documents, monkeypatch):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    rng = random.Random(5)
    base = prose(rng, 60).split(" ")
    family = []
    for i in range(24):
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(60)] = rng.choice(WORDS)
        family.append((i, " ".join(own)))
    got = collected(jaccard.similarity_components(documents(family)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(family)


def test_jaccard_dense_region_is_joined_in_blocks(documents, monkeypatch):
    """Variants near a common text, most of them without a link to it, and a close copy of each."""
    for name, value in (("SMALL", 5), ("PIVOTS", 3), ("PART", 7)):
        monkeypatch.setattr(jaccard, name, value)
    calls = []
    block_pairs = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda *a: calls.append(1) or block_pairs(*a))
    rng = random.Random(8)
    base = prose(rng, 100).split(" ")
    family = []
    for i in range(20):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(10, 100)] = rng.choice(WORDS)
        family += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-1], f"end{i}"]))]
    got = collected(jaccard.similarity_components(documents(family)), "doc_id", "n_shingles", "component_id")
    assert got == brute.jaccard_components(family)
    assert len({c for _, _, c in got}) > 1
    assert len(calls) > 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r["vertex"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_url_rules(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.Example.ORG/es/x?q"), (2, "https://example.org/en/12#t"), (3, "http://x.org"), (4, "http://x.org/"),
            (5, "nothing"), (6, None), (7, "http://a.com/de/1"), (8, "http://notcom/de/1"), (9, "http://com/fr/"), (9, "http://com/fr/"),
        ],
        "page_id long, url string",
    ).withColumn("keys", F.lit(1))
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, rules).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("x.org", "", None, "allow"), 4: ("x.org", "/", "org/", "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("a.com", "/de/1", "com/de/", "block"), 8: ("notcom", "/de/1", None, "allow"), 9: ("com", "/fr/", "com/fr/", "allow"),
    }
    assert urls.filter_urls(pages, rules).count() == 10
    assert urls.filter_urls(pages.limit(0), rules).count() == 0
    assert urls.filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == 10


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = [f"host{i}\n/p" for i in range(3000)]
    flat = urls.build_filter(spark.createDataFrame([(k,) for k in keys], "key string"))
    assert urls.passes([k.encode() for k in keys], flat).all()
    assert urls.passes([f"other{i}\n/p".encode() for i in range(3000)], flat).mean() < 0.02


AWKWARD = [
    "a  b   c \n  d", "", " ", "it's. don't! <|endoftext|>. x<|startoftext|> Y,,", "É!! ß. 5, ½. x²; a  b ",
    "a\x1cb . , !! a.b. c-. d'. 12.5, \t x", "İ. ǅ, fooé́. ", "x\0y z", "a \n", "a\n ", "  x  y",
]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_give_the_ids_of_the_whole(name, items):
    path = public_tokenizers.path(name)
    texts = AWKWARD + [t or "" for _, t in items]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    encoded = tokens.Encoder(path, counts=False).ids([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in encoded] == want
    assert [sum(v) for v in tokens.Encoder(path, counts=True).encode([t.encode() for t in texts])] == [len(w) for w in want]


def test_token_counts_come_from_the_cache_the_second_time(spark, documents, items, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    docs = documents(items)
    first = collected(tokens.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit")
    count = spark.read.parquet(cache).count()
    assert count == len({(t or "").strip(" \t\n\x0b\x0c\r") for _, t in items})
    assert collected(tokens.count_tokens(docs, cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == first
    assert spark.read.parquet(cache).count() == count
    tokens.count_tokens(documents([(1, "quite new text")]), cache).collect()
    assert spark.read.parquet(cache).count() == count + 1
    t = Tokenizer.from_file(tokens.WORD_BPE)
    want = sorted((-1 if i is None else i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in items)
    assert [r[:3] for r in first] == want
    assert tokens.count_tokens(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_passages_are_found_and_clean_documents_left(spark, documents):
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (14, 40, 59)] + ["tiny item", ""]
    changed = passages[2].split(" ")
    changed[0] = "else"
    docs = documents([
        (1, f"{prose(rng, 300)} {passages[0]} {prose(rng, 50)}"), (2, passages[1].upper()), (3, prose(rng, 400)),
        (4, f"{prose(rng, 30)} {' '.join(changed)}"), (5, None), (6, "x tiny item y"), (7, passages[1][: len(passages[1]) // 2]),
    ])
    benchmark = spark.createDataFrame(list(enumerate(passages)) + [(9, None)], "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.judge_documents(docs, benchmark).collect()}
    assert got == {1: [0], 2: [1], 3: [], 4: [2], 5: [], 6: [3], 7: []}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 7]
    assert decontaminate.drop_contaminated(docs, benchmark.limit(0)).count() == 7


def test_many_slices_of_items_give_the_same_spans(spark, documents, monkeypatch):
    rng = random.Random(2)
    passages = [prose(rng, 20) for _ in range(12)]
    docs = documents([(i, f"{prose(rng, 20)} {p} {prose(rng, 5)}") for i, p in enumerate(passages)])
    benchmark = spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")
    monkeypatch.setattr(decontaminate, "MAX_ITEM_WORDS", 60)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.judge_documents(docs, benchmark).collect()}
    assert got == {i: [i] for i in range(12)}


def test_multi_index_finds_every_fingerprint_within_the_radius():
    index = decontaminate.Index([(0, b"a b c d e f g h i j")])
    rng = random.Random(0)
    for _ in range(300):
        flips = rng.sample(range(64), rng.randint(0, decontaminate.RADIUS))
        near = index.prints[0]
        for bit in flips:
            near ^= 1 << bit
        assert list(index.near(near)) == [(0, len(flips))]


def test_line_report(documents, items):
    rows = [(i if i is not None else 900 + k, t) for k, (i, t) in enumerate(items)]
    got = collected(lines.line_report(documents(rows)), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert got == brute.line_report(rows)
    assert any(r[2] for r in got)
    assert lines.line_report(documents(rows).limit(0)).count() == 0


def test_chunks_of_one_line_add_up_and_first_stays(documents, monkeypatch):
    rows = [(i, f"own {i}\nsame line") for i in range(60)]
    monkeypatch.setattr(lines, "CHUNK", 7)
    got = lines.line_report(documents(rows), limit=60).agg(F.sum("n_dropped")).first()[0]
    assert got == 60
    assert lines.keep_bitmaps(documents(rows), limit=60, first_stays=True).count() == 59


def test_bitmaps_keep_lines_beyond_their_end():
    keep = lines.keep_bits(lines.bitmap([0, 3]), 20)
    assert np.flatnonzero(~keep).tolist() == [0, 3]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_duplicates(documents, items, keep):
    rows = items + [(503, "one two"), (503, "one two")]
    marked = exact.mark_duplicates(documents(rows), keep).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").encode().lower(), []).append(-1 if i is None else i)
    assert len(marked) == len(rows) and sum(r["kept"] for r in marked) == len(groups)
    if keep == "largest":
        want = sorted((i, max(g), len(g)) for g in groups.values() for i in g)
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], -1 if r["keep_id"] is None else r["keep_id"], r["group_size"]) for r in marked) == want
    left = exact.drop_exact_duplicates(documents(rows), keep)
    assert left.columns == documents(rows).columns and left.count() == len(groups)


def test_exact_dedup_has_no_python(documents, items):
    plan = exact.mark_duplicates(documents(items))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_runs_merge_in_rounds(spark):
    entries = spark.range(1000).select(
        (F.col("id") % 37).cast("long").alias("run"), (F.col("id") % 5).cast("string").alias("text_sha256"),
        F.lit(1).alias("n_bytes"), F.struct(F.col("id").alias("doc_id"), F.col("id").alias("row")).alias("top"),
        F.lit(1).cast("long").alias("group_size"),
    )
    got = {r["text_sha256"]: (r["top"]["doc_id"], r["group_size"]) for r in exact.merge_runs(entries, 37).collect()}
    assert got == {str(k): (995 + k, 200) for k in range(5)}


def test_classifier_on_held_out_rows(spark, documents):
    rng = random.Random(4)
    good = [(i, ". ".join(prose(rng, 12).capitalize() for _ in range(6))) for i in range(200)]
    bad = [(200 + i, prose(rng, 60).upper().replace(" ", "!! ")) for i in range(100)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = documents(good + bad + [(900, None), (901, "")])
    model = quality.fit(docs, labels)
    rows = quality.classify(docs, model).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 300]
    assert held and sum(r["predicted"] == int(r["doc_id"] < 200) for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == brute.held(r["doc_id"], 4, 2) for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert quality.fit(docs, labels.limit(0)) is None
    assert quality.classify(docs, None).where("score = 1").count() == len(rows)


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.1, rng.normal(size=quality.SIZE), rng.normal(0, 0.1, (quality.SIZE, quality.RANK)))
    index, x = quality.features(b"some words to score, some words")
    pairs = sum(
        model.factors[i] @ model.factors[j] * x[a] * x[b]
        for a, i in enumerate(index) for b, j in enumerate(index) if a < b
    )
    z = model.bias + model.linear[index] @ x + pairs
    assert model.score(b"some words to score, some words") == pytest.approx(1 / (1 + np.exp(-z)))


def encoded(items):
    t = Tokenizer.from_file(tokens.BYTE_BPE)
    return [(-1 if i is None else i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in items]


def test_binary_round_trip(spark, documents, items, tmp_path):
    own = [x for x in items if x[0] is not None]
    folder = str(tmp_path / "ids")
    manifest = binary.write_shards(documents(own), folder)
    got = collected(binary.read_shards(manifest, folder), "doc_id", "start", "n_tokens", "ids_crc32")
    want, at = [], 0
    for i, ids in sorted(encoded(own)):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert manifest.agg(F.sum("ids")).first()[0] == at
    nothing = str(tmp_path / "none")
    assert binary.read_shards(binary.write_shards(documents(own).limit(0), nothing), nothing).count() == 0


def test_binary_keeps_rows_with_null_and_equal_ids(documents, items, tmp_path):
    rows = items + [(503, "one two"), (503, "other")]
    folder = str(tmp_path / "ids")
    assert binary.read_shards(binary.write_shards(documents(rows), folder), folder).count() == len(rows)


def test_packing_is_whole_and_gapless(documents, items, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rows = packing.pack_documents(documents(items), with_ids=True).collect()
    found, sequences = {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        if r["doc_id"] is not None:
            own = found.setdefault(r["doc_id"], [])
            assert (r["start"], r["piece"] == 0) == (len(own), not own)
            own += np.frombuffer(r["ids"], "<u4").tolist()
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert found == {i: ids for i, ids in encoded(items) if i >= 0}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(documents(items).limit(0)).count() == 0


def test_two_smaller_pieces_replace_the_smallest():
    bins = packing.best_two_fit(np.array([6, 3, 2, 2]), 10)
    assert sorted(map(sorted, bins)) == [[0, 2, 3], [1]]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 2049, 4000)
    bins = packing.best_two_fit(lengths, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4000))
    assert all(lengths[b].sum() <= 2048 for b in bins)
    assert len(bins) <= 1.02 * max(np.ceil(lengths.sum() / 2048), (lengths > 1024).sum())


def test_pack_round_trip():
    for values in ([], [0], [1, 300, 2], [2**40, 5], [2**63 + 1]):
        assert shared.unpack(shared.pack(np.array(values, np.uint64))).tolist() == values


def test_arrow_text_as_bytes():
    assert shared.as_bytes(pa.array(["é", None, ""])) == ["é".encode(), b"", b""]


@pytest.mark.parametrize("operator", [lm.score_documents, jaccard.similarity_components, exact.mark_duplicates])
def test_empty_tables(documents, operator):
    assert operator(documents([])).count() == 0


def test_pipeline_stages(spark, tmp_path, items):
    rng = random.Random(8)
    passage = prose(rng, 30)
    docs = [(i, t) for i, t in items if i is not None] + [(700, f"{prose(rng, 40)} {passage}")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {i for i, _ in docs}
    groups = {}
    for i, t in docs:
        groups.setdefault((t or "").encode().lower(), []).append(i)
    unique = [(i, t) for i, t in docs if i in {max(g) for g in groups.values()}]
    near = [(i, t) for i, t in unique if (i, i) in {(a, c) for a, _, c in brute.jaccard_components(unique)}]
    left = {i for i, _ in near} - {700}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == left
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"
    ]
