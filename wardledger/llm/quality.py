"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The bracket is the sum of all pairwise interactions <v_i, v_j> x_i x_j, in time linear in
the number of features (sum-of-squares identity). Features: which of 2 ** 15 hashed words
occur, structure statistics of the text (letters, symbols, repetition, line shape), and its
length as metadata. Labels, lang, source and doc_id are no inputs.

The model is fitted on the driver from at most ``MAX_TRAIN`` labelled documents, taken in
the order of a hash of their ids; their features are extracted on Spark. Scoring is one pass
without a shuffle.

Defined results: NULL texts are empty and scored like any text; a NULL doc_id is scored and
never trained on; labels that are NULL are ignored, of contradicting labels the larger
counts; without training labels nothing is known against a text and every score is 1; an
empty table gives an empty result.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import Remembered, as_bytes, fold_of_id, table

MAX_TRAIN = 6000
HASH_BITS = 15
RANK = 4
#: Steps of gradient descent, at least; and passes over the rows, at least.
STEPS = 1200
EPOCHS = 6
BATCH = 64
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.7
STATISTICS = (
    "upper", "symbols", "digits", "pipes", "bangs", "stops", "not_ascii", "white",
    "distinct", "stutter", "word_length", "line_length", "equal_lines", "length", "constant",
)
WORDS = 1 << HASH_BITS
SIZE = WORDS + len(STATISTICS)

_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _WHITE = (
    np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(float)
    for chars in (
        bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b"#$%&*@^~<>{}[]=+_\\", b".,;:?", b" \t\n\x0b\x0c\r"
    )
)


_known = Remembered(lambda word: zlib.crc32(word) & (WORDS - 1))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text; word features have length 1 together."""
    _known.trim()
    own = text.lower().split()
    buckets = np.fromiter(map(_known.__getitem__, own), np.int64, len(own))
    found = np.unique(buckets)
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    n, letters, n_words = max(1, len(text)), max(1.0, chars @ (_UPPER + _LOWER)), max(1, len(own))
    lines = text.split(b"\n")
    statistics = np.array([
        chars @ _UPPER / letters,
        min(1.0, 5 * (chars @ _SYMBOL) / n),
        chars @ _DIGIT / n,
        min(1.0, chars[124] / n_words),
        min(1.0, chars[33] / n_words),
        min(1.0, chars @ _STOP / n_words),
        chars[128:].sum() / n,
        chars @ _WHITE / n,
        len(set(own)) / n_words,
        float((buckets[1:] == buckets[:-1]).mean()) if len(buckets) > 1 else 0.0,
        min(1.0, len(text) / n_words / 20),
        min(1.0, len(text) / len(lines) / 1000),
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(len(text)) / 15),
        1.0,
    ])
    index = np.append(found, np.arange(WORDS, SIZE))
    return index, np.append(np.full(len(found), len(found) ** -0.5 if len(found) else 0.0), statistics)


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def score(self, text: bytes) -> float:
        index, x = features(text)
        v = self.factors[index] * x[:, None]
        both = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.linear[index] @ x + both, -30, 30))))


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> Model:
    """Logistic loss by AdaGrad over mini-batches of sparse rows."""
    rng = np.random.default_rng(seed)
    rate = labels.mean()
    model = Model(float(np.log(max(rate, 1e-3) / max(1 - rate, 1e-3))), np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)))
    seen_linear, seen_factors = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            index = np.concatenate([rows[i][0] for i in some])
            x = np.concatenate([rows[i][1] for i in some])
            sizes = np.array([len(rows[i][0]) for i in some])
            row = np.repeat(np.arange(len(some)), sizes)
            starts = np.cumsum(sizes) - sizes
            v = model.factors[index] * x[:, None]
            total = np.add.reduceat(v, starts)
            both = 0.5 * (total**2 - np.add.reduceat(v**2, starts)).sum(axis=1)
            z = model.bias + np.add.reduceat(model.linear[index] * x, starts) + both
            slope = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]) / len(some)
            found, inverse = np.unique(index, return_inverse=True)
            step = slope[row] * x
            linear = np.bincount(inverse, step, len(found)) + DECAY * model.linear[found]
            move = step[:, None] * (total[row] - v)
            factors = np.stack([np.bincount(inverse, move[:, f], len(found)) for f in range(RANK)], axis=1)
            factors += DECAY * model.factors[found]
            seen_linear[found] += linear**2
            seen_factors[found] += factors**2
            model.linear[found] -= RATE * linear / np.sqrt(seen_linear[found])
            model.factors[found] -= RATE * factors / np.sqrt(seen_factors[found])
            model.bias -= RATE * slope.sum()
    return model


def _features(batches):
    for batch in batches:
        made = [features(t) for t in as_bytes(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([i for i, _ in made], pa.list_(pa.int32())),
                pa.array([x for _, x in made], pa.list_(pa.float64())),
            ],
            ["quality", "index", "x"],
        )
    _known.clear()


def fit(docs: DataFrame, labels: DataFrame, held_fold: int = 2, folds: int = 4, most: int = MAX_TRAIN) -> Model | None:
    """The model of the labelled documents outside ``held_fold``; None without any."""
    chosen = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(fold_of_id(F.col("doc_id"), folds) != held_fold)
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    # At most ``most`` ids and labels: small enough for every task.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id, the one with the last text: no more rows than ids are collected.
    texts = texts.groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
    rows = texts.select(F.col("quality").cast("double").alias("quality"), "text").mapInArrow(
        _features, "quality double, index array<int>, x array<double>"
    ).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["index"], r["x"]))  # the same model from any order of tasks
    sparse = [(np.array(r["index"], np.int64), np.array(r["x"])) for r in rows]
    return fit_rows(sparse, np.array([r["quality"] for r in rows]))


def _score(model):
    def run(batches):
        known = model.value
        for batch in batches:
            scores = [known.score(t) for t in as_bytes(batch.column("__text"))]
            rest = batch.drop_columns(["__text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(scores, pa.float64())], [*rest.schema.names, "__score"])
        _known.clear()

    return run


def score_column(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with its columns and ``__score``."""
    if model is None:
        return docs.withColumn("__score", F.lit(1.0))
    names = {name: f"__c{i}" for i, name in enumerate(docs.columns)}
    moved = docs.select(*(F.col(f"`{old}`").alias(new) for old, new in names.items()), F.col("text").alias("__text"))
    fields = ", ".join(f"{names[f.name]} {f.dataType.simpleString()}" for f in docs.schema.fields)
    scored = moved.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"{fields}, __score double")
    return scored.select(*(F.col(new).alias(old) for old, new in names.items()), "__score")


def classify(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    return score_column(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold_of_id(F.col("doc_id"), folds) == held_fold).alias("held_out"),
        F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model accepts, with all their columns."""
    return score_column(docs, model).where(F.col("__score") >= threshold).drop("__score")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))
