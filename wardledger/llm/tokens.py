"""Tokenizing whole texts with the tokenizers library, and cached token counts.

``Encoder`` calls the library once for each distinct piece of text that a task meets. Texts
are cut only where the tokenizer itself always cuts, so that the pieces give the same ids
as the whole: see ``SPLIT``.

Token counts come from a digest cache: a table of (content digest, tokenizer digest,
n_tokens). Normalised contents are joined with it, only distinct misses are encoded, and
their counts are appended as new files.

Defined results: NULL text is empty; an empty text has no token; rows with equal ids get a
row each; an empty table gives an empty result and appends nothing.
"""

import hashlib
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import as_bytes, fresh_path, small_batches, table, write_table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Bytes of pieces and values, about, in each of the two generations that a Python worker remembers.
REMEMBER = 64 << 20
#: What a piece takes beside its bytes and those of its value.
ENTRY = 180
#: Where the two kinds of tokenizer always cut. "words": at ASCII white space, which the
#: pre-tokenizer drops. "spaces": before a single space, which begins the next token; a
#: space next to other white space may join it, so such texts go to the library whole, as
#: do those that hold a special token.
SPLIT = {"word_bpe_49k.json": "words", "byte_bpe_50k.json": "spaces"}
_JOINED = re.compile(r"\s (?:\s|$)")
#: A later piece, without the space before it, that is one word.
_WORD = re.compile(r"[^\s\0]\S*")

#: Punctuation that never joins a letter or digit before it in one token; the apostrophe may.
PUNCTUATION = b".,!?#$%&*:;|"
_MARKS = tuple(bytes([x]) for x in PUNCTUATION)

#: How a byte-level vocabulary writes a space.
SPACE_TOKEN = "\u0120"

_encoders: dict[tuple, "Encoder"] = {}


class Encoder:
    """Ids of texts. One of each kind lives on in a Python worker."""

    def __init__(self, path: str, counts: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = SPLIT.get(path.rpartition("/")[2])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Recent pieces, and those of the generation before; a piece of the latter that comes
        # again is recent, and the rest of it goes when the recent ones are full.
        self.known: dict[bytes, object] = {}
        self.before: dict[bytes, object] = {}
        self.held, self.remember = 0, REMEMBER
        # Ids of tokens that begin with a space: in a row of words, each starts one.
        self.opens = None
        if self.split == "spaces" and not counts:
            vocabulary = self.tokenizer.get_vocab()
            self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
            self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE_TOKEN)]] = True
        self.value = (lambda e: len(e)) if counts else (lambda e: np.array(e.ids, "<u4").tobytes())

    @classmethod
    def of(cls, path: str, counts: bool = False, remember: int | None = None) -> "Encoder":
        """The encoder of a worker; ``remember`` bounds each generation of its pieces in bytes."""
        key = (path, counts)
        if key not in _encoders:
            _encoders[key] = cls(path, counts)
        _encoders[key].remember = remember or REMEMBER
        return _encoders[key]

    def forget(self) -> None:
        """Let go of all pieces, so that a reused worker carries none of them on."""
        self.known, self.before, self.held = {}, {}, 0

    def whole(self, texts: list[str]) -> list:
        return [self.value(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def each(self, pieces: list[bytes]) -> list[tuple[bytes, object]]:
        """Values of single pieces. Words without white space are encoded in one row."""
        row, rest = [], pieces
        if self.opens is not None:
            row = [p for p in pieces if _WORD.fullmatch(p.decode())]
        done = []
        if row:
            text = (b" " + b" ".join(row)).decode()
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(row):
                data, ends = ids.tobytes(), [*(4 * at[1:]).tolist(), 4 * len(ids)]
                done = [(p, data[i:j]) for p, i, j in zip(row, (4 * at).tolist(), ends)]
                found = set(row)
                rest = [p for p in pieces if p not in found]
        return done + list(zip(rest, self.whole([self.text_of(p) for p in rest])))

    def pieces(self, data: bytes) -> list[bytes] | None:
        """Pieces whose ids, one after the other, are those of the text; None: encode it whole."""
        if self.split == "words":  # this kind folds case itself, but finds special tokens before
            return data.split() if b"<|" in data else data.lower().split()
        if self.split == "spaces":
            text = data.decode()
            if _JOINED.search(text) or any(s in text for s in self.special):
                return None
            first, *rest = data.split(b" ")
            # A later piece is kept without its space; the first is told apart by a NUL byte.
            return ([b"\0" + first] if first else []) + rest
        return None

    def text_of(self, piece: bytes) -> str:
        if self.split == "words":
            return piece.decode()
        return (piece[1:] if piece[:1] == b"\0" else b" " + piece).decode()

    def core(self, piece: bytes) -> tuple[bytes, bytes] | None:
        """A piece that ends in punctuation as two pieces."""
        core = piece.rstrip(PUNCTUATION)
        last = core[-4:].decode(errors="ignore")[-1:]
        # A letter whose lower case ends in a combining mark would join the punctuation.
        if core == piece or not last.isalnum() or len(last.lower()) > 1:
            return None
        end = piece[len(core) :]
        return core, end if self.split == "words" else b"\0" + end

    def encode(self, texts: list[bytes]):
        """For each text the values of its pieces."""
        if self.held > self.remember:
            self.before, self.known, self.held = self.known, {}, 0
        cut = [None if b"\0" in t else self.pieces(t) for t in texts]
        known, before = self.known, self.before
        got, gaps, new = [], [], set()
        for parts in cut:
            # One look-up a piece; only what was missing is looked up again.
            values = None if parts is None else list(map(known.get, parts))
            gap = [k for k, v in enumerate(values) if v is None] if parts and None in values else []
            new.update([parts[k] for k in gap])
            got.append(values)
            gaps.append(gap)
        met = {p: before[p] for p in new if p in before}
        new -= met.keys()
        ends = {p: c for p in new if p.endswith(_MARKS) and (c := self.core(p))}
        met.update((p, before[p]) for pair in ends.values() for p in pair if p in before and p not in known)
        known.update(met)
        alone = [p for p in {*(new - ends.keys()), *(c for c, _ in ends.values()), *(e for _, e in ends.values())} if p not in known]
        for i in range(0, len(alone), 4096):
            known.update(self.each(alone[i : i + 4096]))
        known.update((p, known[c] + known[e]) for p, (c, e) in ends.items())
        for some in (met, alone, ends):
            self.held += sum(map(len, some)) + ENTRY * len(some)
        rest = [i for i, parts in enumerate(cut) if parts is None]
        whole = dict(zip(rest, self.whole([texts[i].decode() for i in rest])))
        for i, (parts, gap) in enumerate(zip(cut, gaps)):
            if parts is None:
                got[i] = [whole[i]]
            for k in gap:
                got[i][k] = known[parts[k]]
        return got

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(values) for values in self.encode(texts)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _count(path: str):
    def run(batches):
        encoder = Encoder.of(path, counts=True)
        for batch in batches:
            for part in small_batches(batch):
                counts = [sum(values) for values in encoder.encode(as_bytes(part.column(1)))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


CACHE = "digest string, tokenizer string, n_tokens long"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def count_tokens(docs: DataFrame, cache: str, path: str = WORD_BPE, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row; new counts go to ``cache``.

    Normalised content: NULL as empty and no ASCII white space at the ends, which a "words"
    tokenizer drops; other tokenizers get the text as it is.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    words = SPLIT.get(path.rpartition("/")[2]) == "words"
    content = F.btrim(text, F.lit(" \t\n\x0b\x0c\r")) if words else text
    digest = F.sha2(content, 256)
    version = tokenizer_digest(path)
    keyed, _ = write_table(
        docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest")), "contents"
    )
    stored = None
    if _exists(spark, cache):
        stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    misses = keyed if stored is None else keyed.join(stored, "digest", "left_anti")
    # One row stands for each missing content. Its text is found by id and digest, so that
    # a content shared by many rows is no hot key.
    chosen = misses.groupBy("digest").agg(F.max("doc_id").alias("__id"))
    texts = docs.select("doc_id", content.alias("content"), digest.alias("__digest")).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("digest")), "inner"
    )
    (
        texts.select("digest", "content").mapInArrow(_count(path), "digest string, n_tokens long")
        .dropDuplicates(["digest"]).select("digest", F.lit(version).alias("tokenizer"), "n_tokens")
        .write.mode("append").parquet(cache)
    )
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    # A task that failed after its commit may have appended a count twice.
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "token-counts"))
