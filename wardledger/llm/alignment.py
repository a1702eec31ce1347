"""Alignment of the tokens of two tokenizers over the same texts.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts a space
itself. Places where tokens of both end cut a text into groups; a link is a pair of an A and a B
token whose bytes overlap. Counts of linked id pairs over the corpus say which A ids a B id
stands for.

*Identity fast path.* For every A id the B id of the same bytes is known beforehand. A group of
one A and one B token that are such a pair only adds one in a vector as long as A's vocabulary.
Only the links of all other groups enter the shuffle of pairs, once for each distinct pair of a
block, with its count. The vectors are added up by A id, so no more than one number for each id
and block is shuffled.

Texts are read in blocks of about ``BLOCK`` bytes. Both tokenizers always cut before a single
space between two other characters, so a text is the sequence of its words, and each distinct
word of a block is encoded and aligned once (``Words``); a text with other white space beside a
space is one word. A block keeps its documents as numbers of words, and its words as numbers of
links: the totals of the corpus come back to it once for each distinct pair, are added up for each
word, and then for each document. A task holds one block. Broadcast are vectors as long as a
vocabulary, and nothing else.

Defined results: NULL is empty; an empty text, and one whose tokens of A or B do not give back
its bytes (for B any text with U+2581), has no tokens: zeros and ''; rows with equal ids or texts
each count; an empty table gives an empty result; extra columns are ignored.
"""

import hashlib
import itertools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.blocks import _Numbers
from wardledger.llm.shared import as_bytes, pack, table, unpack, write_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
BLOCK = 1 << 24
#: Words that are encoded in one row.
ROW = 4096
#: White space that may join a space in one token, and U+2581, which B writes as a space.
_WHOLE = re.compile(r"(?:^|\s) |\s\Z| \s")
_SPACE_MARK = "▁"
PAIR = 32  # a pair is A's id shifted by so many bits, and B's id

BLOCKS = (
    "block long, ids array<long>, n_a binary, n_b binary, n_groups binary, n_links binary, hashes array<string>, "
    "words binary, words_of binary, links binary, links_of binary, same binary, same_of binary, "
    "pairs binary, pair_counts binary, vector binary"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)

_loaded: dict[tuple, "Vocabularies"] = {}


class Vocabularies:
    """Both tokenizers with the bytes of their ids. One pair lives on in a Python worker."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [_byte_level(self.a.id_to_token(i) or "") for i in range(size)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_MARK, " ").encode()
            for i in range(self.b.get_piece_size())
            for p in [self.b.id_to_piece(i)]
        ]
        self.a_len = np.array([*map(len, self.a_bytes)], np.int64)
        self.b_len = np.array([*map(len, self.b_bytes)], np.int64)
        # A word begins with a space, and no other token of it does.
        self.a_opens = np.array([x[:1] == b" " for x in self.a_bytes])
        self.b_opens = np.array([x[:1] == b" " for x in self.b_bytes])
        of_bytes = {x: i for i, x in enumerate(self.b_bytes)}
        self.identity = np.array([of_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        # Ids as text, with what follows them in a list of groups.
        self.a_text = [np.array([f"{i}{end}" for i in range(size)], object) for end in ",|"]
        self.b_text = [np.array([f"{i}{end}" for i in range(len(self.b_bytes))], object) for end in ",;"]

    @classmethod
    def of(cls, a: str, b: str) -> "Vocabularies":
        if (a, b) not in _loaded:
            _loaded[a, b] = cls(a, b)
        return _loaded[a, b]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        return np.array(ids, np.int64), np.array(self.b.encode(text, num_threads=1), np.int64)

    def row(self, words: list[bytes]):
        """Ids of words and how many belong to each; None where they cannot be told apart."""
        a, b = self.encode(b" ".join(words).decode())
        sides = []
        for ids, opens, lengths, tokens in ((a, self.a_opens, self.a_len, self.a_bytes), (b, self.b_opens, self.b_len, self.b_bytes)):
            at = np.flatnonzero(opens[ids])
            if len(at) != len(words) or b"".join(map(tokens.__getitem__, ids.tolist())) != b" " + b" ".join(words):
                return None
            sides.append((ids, np.diff(np.append(at, len(ids)))))
        return sides

    def single(self, word: bytes):
        """As ``row`` for one word; no ids where the bytes do not come back."""
        a, b = self.encode(word.decode())
        want = b" " + word
        if any(b"".join(map(t.__getitem__, ids.tolist())) != want for ids, t in ((a, self.a_bytes), (b, self.b_bytes))):
            a = b = np.zeros(0, np.int64)
        return [(a, np.array([len(a)])), (b, np.array([len(b)]))]


def _byte_level(token: str) -> bytes:
    """Bytes of a byte-level token: printable Latin-1 stands for itself, the rest from U+0100 on."""
    return bytes(map(_byte_of().__getitem__, token)) if all(c in _byte_of() for c in token) else token.encode()


def _byte_of(made: dict = {}) -> dict[str, int]:
    if not made:
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [x for x in range(256) if x not in plain]
        made.update({chr(x): x for x in plain} | {chr(0x100 + k): x for k, x in enumerate(rest)})
    return made


class Words:
    """Alignment of words: counts, links and group texts of each, in order of their numbers."""

    def __init__(self):
        self.parts: dict[str, list[np.ndarray]] = {}
        self.texts: list[str] = []

    def add(self, name: str, values: np.ndarray) -> None:
        self.parts.setdefault(name, []).append(values)

    def get(self, name: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *self.parts.get(name, [])])


def align(v: Vocabularies, a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, out: Words) -> None:
    """Align words whose tokens follow each other in ``a`` and ``b``; ``a_of`` and ``b_of`` tell how many each has."""
    n = len(a_of)
    a_end, b_end = np.cumsum(v.a_len[a]), np.cumsum(v.b_len[b])
    ends = np.union1d(a_end, b_end)  # each piece between ends is the overlap of one A and one B token
    group_end = np.intersect1d(a_end, b_end, assume_unique=True)
    link_a, link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    a_group, b_group = np.searchsorted(group_end, a_end), np.searchsorted(group_end, b_end)
    a_word, b_word = np.repeat(np.arange(n), a_of), np.repeat(np.arange(n), b_of)
    groups = len(group_end)
    in_a, in_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    first = np.searchsorted(a_group, np.arange(groups))
    group_word = a_word[first]
    link_group, link_word = a_group[link_a], a_word[link_a]
    regular = (in_a == 1) & (in_b == 1)
    regular[regular] = v.identity[a[first[regular]]] == b[np.searchsorted(b_group, np.flatnonzero(regular))]
    fast = regular[link_group]
    out.add("n_a", a_of)
    out.add("n_b", b_of)
    out.add("n_groups", np.bincount(group_word, minlength=n))
    out.add("n_links", np.bincount(link_word, minlength=n))
    out.add("same", a[link_a[fast]])
    out.add("same_of", np.bincount(link_word[fast], minlength=n))
    out.add("links", (a[link_a[~fast]] << PAIR) | b[link_b[~fast]])
    out.add("links_of", np.bincount(link_word[~fast], minlength=n))
    # Text of the groups: A's ids of a group, then B's.
    a_last, b_last = np.append(a_group[1:] != a_group[:-1], True), np.append(b_group[1:] != b_group[:-1], True)
    pieces = np.concatenate([np.where(a_last, v.a_text[1][a], v.a_text[0][a]), np.where(b_last, v.b_text[1][b], v.b_text[0][b])]) if n and len(a) else np.zeros(0, object)
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    own = pieces[order].tolist()
    sizes = np.fromiter(map(len, own), np.int64, len(own))
    of_word = np.concatenate([a_word, b_word])[order]
    cut = np.append(0, np.cumsum(np.bincount(of_word, sizes, minlength=n).astype(np.int64))).tolist()
    text = "".join(own)
    out.texts += [text[i:j] for i, j in itertools.pairwise(cut)]


def align_words(v: Vocabularies, words: list[bytes], whole: list[bool]) -> Words:
    out = Words()

    def one(word):
        (a, a_of), (b, b_of) = v.single(word)
        align(v, a, a_of, b, b_of, out)

    at = 0
    while at < len(words):
        if whole[at]:
            one(words[at])
            at += 1
            continue
        to = at
        while to < len(words) and to - at < ROW and not whole[to]:
            to += 1
        if sides := v.row(words[at:to]):
            (a, a_of), (b, b_of) = sides
            align(v, a, a_of, b, b_of, out)
        else:
            for word in words[at:to]:
                one(word)
        at = to
    return out


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of ``values``; ``of`` tells how long each is."""
    total = np.append(0, np.cumsum(values))
    end = np.cumsum(of)
    return total[end] - total[end - of]


def _blocks(a_path: str, b_path: str, limit: int):
    def run(batches):
        v = Vocabularies.of(a_path, b_path)
        ids, stream, words_of, names, whole, size, number = [], [], [], None, {}, 0, 0

        def block():
            words = list(names)
            out = align_words(v, words, [w in whole for w in words])
            n_words = np.array(words_of, np.int64)
            flow = np.concatenate([np.zeros(0, np.int64), *stream])
            broken = _sums((out.get("n_a")[flow] == 0).astype(np.int64), n_words) > 0
            if broken.any():  # a word whose bytes do not come back leaves its text without tokens
                flow = flow[~np.repeat(broken, n_words)]
                n_words[broken] = 0
            hashes, texts = [], out.texts
            for part in np.split(flow, np.cumsum(n_words)[:-1]):
                groups = "".join(map(texts.__getitem__, part.tolist()))
                hashes.append(hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else "")
            seen = np.bincount(flow, minlength=len(words))
            same, same_of, links, links_of = (out.get(n) for n in ("same", "same_of", "links", "links_of"))
            vector = np.bincount(same, np.repeat(seen, same_of), minlength=len(v.a_bytes)).astype(np.int64)
            pairs, place = np.unique(links, return_inverse=True)
            counts = np.bincount(place, np.repeat(seen, links_of), minlength=len(pairs)).astype(np.int64)
            used = counts > 0  # words of broken texts alone are not
            return pa.RecordBatch.from_pydict({
                "block": [(TaskContext.get().partitionId() << 32) + number],
                "ids": pa.array([ids], pa.list_(pa.int64())),
                **{n: [pack(_sums(out.get(n)[flow], n_words))] for n in ("n_a", "n_b", "n_groups", "n_links")},
                "hashes": pa.array([hashes], pa.list_(pa.string())),
                "words": [pack(flow)], "words_of": [pack(n_words)],
                "links": [pack(place)], "links_of": [pack(links_of)],
                "same": [pack(same)], "same_of": [pack(same_of)],
                "pairs": [pack(np.diff(pairs, prepend=0))], "pair_counts": [pack(np.where(used, counts, 0))],
                "vector": [pack(vector)],
            })

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if names is None:
                    names = _Numbers({}, itertools.count())
                text = data.decode()
                if not data or _SPACE_MARK in text:
                    parts = []
                elif _WHOLE.search(text):
                    parts = [data]
                    whole[data] = True
                else:
                    parts = data.split(b" ")
                ids.append(doc)
                stream.append(np.fromiter(map(names.__getitem__, parts), np.int64, len(parts)))
                words_of.append(len(parts))
                size += len(data)
                if size >= limit:
                    yield block()
                    ids, stream, words_of, names, whole, size, number = [], [], [], None, {}, 0, number + 1
        if ids:
            yield block()

    return run


def _pair_rows(batches):
    """(pair, n) of each distinct pair of a block, with its block."""
    for batch in batches:
        for block, pairs, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            own, n = np.cumsum(unpack(pairs).astype(np.int64)), unpack(counts).astype(np.int64)
            keep = np.flatnonzero(n)
            for s in range(0, len(keep), 1 << 16):
                at = keep[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), block)), pa.array(own[at]), pa.array(n[at])], ["block", "pair", "n"]
                )


def _vector_rows(batches):
    """(a, n) of the ids that a block has met on the fast path."""
    for batch in batches:
        for data in batch.column(0).to_pylist():
            n = unpack(data).astype(np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["a", "n"])


def pair_counts(blocks: DataFrame, v: Vocabularies) -> tuple[DataFrame, DataFrame]:
    """(block, pair, n) of the slow path, and (pair, total, best) of all linked pairs of the corpus."""
    pairs = blocks.select("block", "pairs", "pair_counts").mapInArrow(_pair_rows, "block long, pair long, n long")
    vector = blocks.select("vector").mapInArrow(_vector_rows, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    identity = v.identity

    def named(batches):
        for batch in batches:
            a = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((a << PAIR) | identity[a]), batch.column(1)], ["pair", "n"])

    totals = (
        pairs.select("pair", "n").unionByName(vector.mapInArrow(named, "pair long, n long"))
        .groupBy("pair").agg(F.sum("n").alias("total"))
    )
    totals, _ = write_table(totals, "pair-totals")
    b = F.col("pair").bitwiseAND((1 << PAIR) - 1)
    # One row for each id of B: as many as its vocabulary at most.
    best = totals.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    marked = totals.join(F.broadcast(best), b == F.col("b")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    return pairs, marked


def _answer(totals: np.ndarray, best: np.ndarray):
    """Documents of a block from the totals of its pairs; vectors hold those of the fast path."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        pairs, n, top = (np.asarray(right[c]) for c in ("pair", "total", "best"))
        order = np.argsort(pairs)
        pairs, n, top = pairs[order], n[order].astype(np.int64), top[order].astype(np.int64)
        for row in left.to_pylist():
            own = np.cumsum(unpack(row["pairs"]).astype(np.int64))
            place = np.searchsorted(pairs, own)
            place[place == len(pairs)] = 0
            # Pairs that only words of broken texts have are not counted, and no document asks for them.
            known = pairs[place] == own if len(pairs) else np.zeros(len(own), bool)
            links, same = unpack(row["links"]).astype(np.int64), unpack(row["same"]).astype(np.int64)
            links_of, same_of = unpack(row["links_of"]).astype(np.int64), unpack(row["same_of"]).astype(np.int64)
            words, words_of = unpack(row["words"]).astype(np.int64), unpack(row["words_of"]).astype(np.int64)
            figures = []
            for slow, fast in ((top, best), (n, totals)):
                of_pair = np.where(known, slow[place], 0) if len(pairs) else np.zeros(len(own), np.int64)
                of_word = _sums(of_pair[links], links_of) + _sums(fast[same], same_of)
                figures.append(_sums(of_word[words], words_of))
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], pa.int64()),
                **{c: pa.array(unpack(row[c]).astype(np.int64)) for c in ("n_a", "n_b", "n_groups", "n_links")},
                "n_best": pa.array(figures[0]), "count_sum": pa.array(figures[1]),
                "groups_sha256": pa.array(row["hashes"], pa.string()),
            }))
        return pa.concat_tables(out) if out else _EMPTY

    return run


_EMPTY = pa.table({
    "doc_id": pa.array([], pa.int64()),
    **{c: pa.array([], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")},
    "groups_sha256": pa.array([], pa.string()),
})


def align_documents(docs: DataFrame, a: str = BYTE_BPE, b: str = PIECE_BPE, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Figures of every row of ``docs``, and the counts of all linked pairs (a, b, total, best)."""
    v = Vocabularies.of(a, b)
    blocks, _ = write_table(docs.select("doc_id", "text").mapInArrow(_blocks(a, b, block), BLOCKS), "token-blocks")
    pairs, marked = pair_counts(blocks, v)
    marked, _ = write_table(marked, "marked-pairs")
    a_id, b_id = F.shiftright("pair", PAIR), F.col("pair").bitwiseAND((1 << PAIR) - 1)
    # Pairs of the fast path, one for each id of A at most, as vectors.
    same = blocks.sparkSession.createDataFrame([(i << PAIR | x,) for i, x in enumerate(v.identity.tolist()) if x >= 0], "pair long")
    totals, best = np.zeros(len(v.identity), np.int64), np.zeros(len(v.identity), np.int64)
    for r in marked.join(F.broadcast(same), "pair").collect():
        totals[r["pair"] >> PAIR], best[r["pair"] >> PAIR] = r["total"], r["best"]
    answers = pairs.join(marked, "pair").select("block", "pair", "total", "best")
    figures = blocks.drop("vector", "pair_counts").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answer(totals, best), RESULT)
    return figures, marked.select(a_id.alias("a"), b_id.alias("b"), "total", "best")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))[0]
