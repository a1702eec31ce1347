"""Bounds of what workers remember, repeated ids, and clashing names."""

import random
import zlib

from tests.llm.test_operators import prose
from wardledger.llm import binary, exact, quality, shared, tokens
from wardledger.llm.shared import Remembered


def test_remembered_words_take_bounded_bytes():
    known = Remembered(len, limit=10_000)
    for i in range(1000):
        known.trim()
        assert known[b"word%d" % i] == len(b"word%d" % i)
        assert known.size <= 10_200
    known.clear()
    assert not known and known.size == 0


def test_two_generations_of_pieces_give_the_same_ids():
    rng = random.Random(6)
    texts = [prose(rng, 60).encode() for _ in range(200)]
    whole = tokens.Encoder(tokens.BYTE_BPE, False).ids(texts)
    small = tokens.Encoder(tokens.BYTE_BPE, False)
    small.remember = 5_000
    assert [x for i in range(0, 200, 10) for x in small.ids(texts[i : i + 10])] == whole
    assert small.before and small.held < 60_000
    counts = tokens.Encoder(tokens.WORD_BPE, True)
    want = [len(e) for e in counts.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    assert [sum(v) for i in range(0, 200, 10) for v in counts.encode(texts[i : i + 10])] == want


def test_repeated_ids_do_not_widen_the_sample(spark, documents, monkeypatch):
    docs = documents([(1, f"text {i}") for i in range(50)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    rows = []
    monkeypatch.setattr(quality, "fit_rows", lambda found, y, seed=5: rows.append(len(found)))
    quality.fit(docs, labels, held_fold=9)
    assert rows == [2]


def test_columns_named_like_ours_are_kept(spark):
    docs = spark.createDataFrame(
        [(1, "A b", "x", "p", 7), (2, "a B", "y", "q", 8), (3, None, "z", "r", 9)],
        "doc_id long, text string, __id string, __DIGEST string, __copy int",
    )
    assert sorted(map(tuple, exact.drop_exact_duplicates(docs).collect())) == [(2, "a B", "y", "q", 8), (3, None, "z", "r", 9)]


def test_folders_without_a_scheme_are_those_of_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert shared.qualified(spark, str(tmp_path)) == f"file:{tmp_path}"
    assert shared.qualified(spark, f"file://{tmp_path}") in (f"file:{tmp_path}", f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://shared/")
    conf.set("fs.viewfs.mounttable.shared.link./folder", f"file://{tmp_path}")
    try:
        assert shared.qualified(spark, "/folder") == "viewfs://shared/folder"
    finally:
        conf.set("fs.defaultFS", before or "file:///")
    assert binary._place(f"file:{tmp_path}")[1] == binary._place(f"file://{tmp_path}")[1] == str(tmp_path)


def test_shards_are_read_in_blocks_of_any_size(spark, documents, monkeypatch, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([0, 1, 30, 300]))) for i in range(60)] + [(None, "no id"), (70, None)]
    manifest = binary.write_shards(documents(rows), str(tmp_path))
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = binary.read_shards(manifest, str(tmp_path)).select(columns).orderBy("start").collect()
    encoder = tokens.Encoder.of(binary.BYTE_BPE)
    own = {i: encoder.ids([(t or "").encode()])[0] + binary.END for i, t in rows}
    assert [(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in whole] == [
        (i, len(own[i]) // 4, zlib.crc32(own[i])) for i in sorted(own, key=lambda i: -1 if i is None else i)
    ]
    assert [r["start"] for r in whole] == [sum(r["n_tokens"] for r in whole[:k]) for k in range(len(whole))]
    for most_ids, most_docs in ((1, 4096), (100, 4096), (1 << 20, 7)):
        monkeypatch.setattr(binary, "READ_IDS", most_ids)
        monkeypatch.setattr(binary, "READ_DOCS", most_docs)
        blocks = binary._read(f"file://{tmp_path}")([r for r in manifest.toArrow().to_batches()])
        got = [tuple(r.values()) for b in blocks for r in b.to_pylist()]
        assert sorted(got, key=lambda r: r[1]) == [tuple(r) for r in whole]


def test_only_words_that_end_in_punctuation_are_looked_at_for_it(monkeypatch):
    encoder = tokens.Encoder(tokens.BYTE_BPE, False)
    asked, core = [], encoder.core
    monkeypatch.setattr(encoder, "core", lambda p: asked.append(p) or core(p))
    text = "one two, three four; five's (six) seven|"
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids([text.encode()]) == [b"".join(i.to_bytes(4, "little") for i in want)]
    assert sorted(asked) == [b"four;", b"seven|", b"two,"]


def test_new_words_get_their_ids_without_a_text_each(monkeypatch):
    encoder = tokens.Encoder(tokens.BYTE_BPE, False)
    made, text_of = [], encoder.text_of
    monkeypatch.setattr(encoder, "text_of", lambda p: made.append(p) or text_of(p))
    text = "first second \u00e9t\u00e9 two\nlines x\u00a0y fourth"
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.ids([text.encode()]) == [b"".join(i.to_bytes(4, "little") for i in want)]
    assert sorted(made) == sorted([b"\0first", b"two\nlines", "x\u00a0y".encode()])
