"""Hard negatives of anchors: slot-decomposed selection.

Each anchor has up to ``POSITIVES`` positives, its first rows of the same label by (score
descending, vec_id ascending). For each positive with score p the operator returns the first
``NEGATIVES`` rows of another label whose score n lies in the window ``low`` * p <= 100 * n <=
100 * p. The windows of an anchor overlap. The positives' scores, their upper limits, cut the
scores into disjoint slots: slot j holds the scores from just above the next smaller limit up to
limit j. A row falls into one slot, combiners keep the first ``NEGATIVES`` of each slot, and the
rows for limit j are the first of slots j, j + 1, ..., merged from the lowest slot upwards. The
lower limit only cuts the end of such a list.

Anchors are compared with all rows in blocks. Rows are packed once into blocks of at most
``BLOCK`` rows, anchors are dealt to groups of about ``GROUP``, and each (block, group) pair is
one matrix product in one task: a task holds one block and one group, whatever the input, and
what is shuffled is small beside the products. Each pair returns the first few rows of each
anchor or slot, and a ranked window cut at a few rows, which Spark also applies before its
shuffle, joins them. Nothing is broadcast or collected.

Scores are exact integers. Components become floor(256 * x), x as double, and those beyond
+-2**31 count as that. Products are made in floating point where all sums stay below 2**53,
in 64-bit integers below 2**63, and in Python's integers otherwise; scores beyond +-2**55 count
as that.

Defined results: a row with a NULL label or vector, or with a NULL, NaN or infinite component,
takes no part; of vectors of unequal length the shorter is filled up with zeros, so an empty one
scores 0; a NULL id comes last among ties and is no anchor; each row is itself, so rows that
repeat an id are "other rows" of each other, and each anchor row has its own result; an anchor
without positives or without negatives in its windows returns nothing; an empty table gives an
empty result. Extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardledger.llm.shared import table, write_table

POSITIVES, NEGATIVES = 5, 5
BLOCK = 1 << 14
GROUP = 1 << 11
#: Scores of so many (anchor, row) pairs are looked at together.
TILE = 1 << 20
LARGEST = 1 << 31
SCORE_LIMIT = 1 << 55

BLOCKS = "block long, ids array<long>, labels binary, dim int, width int, q binary"
ANCHORS = "key long, anchor_id long, label long, dim int, q array<long>"


def _quantised(column) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and their components as a matrix, short vectors filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
    flat = lists.flatten().cast(pa.float64())
    values = np.asarray(flat.fill_null(float("nan")))
    owner = np.repeat(np.arange(len(lists)), lengths)
    part = np.asarray(lists.is_valid()).copy()
    part[owner[~np.isfinite(values)]] = False
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    matrix = np.zeros((len(lists), int(lengths.max(initial=0))), np.int64)
    good = part[owner]
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(256.0 * values[good]), -LARGEST, LARGEST)
    matrix[owner[good], place[good]] = scaled.astype(np.int64)
    return part, matrix[part]


def _pack_blocks(batches):
    """Rows (vec_id, label, embedding) that take part as blocks, sorted by id with NULL last."""
    number = 0
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(start, BLOCK)
            part, matrix = _quantised(rows.column(2))
            labelled = np.asarray(rows.column(1).is_valid())
            matrix, part = matrix[labelled[part]], part & labelled
            if not part.any():
                continue
            ids = rows.column(0).filter(pa.array(part))
            labels = np.asarray(rows.column(1).filter(pa.array(part))).astype("<i8")
            order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
            most = int(np.abs(matrix).max(initial=0))
            width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
            yield pa.RecordBatch.from_pydict({
                "block": [(TaskContext.get().partitionId() << 20) + number],
                "ids": pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(pa.int64())),
                "labels": [labels[order].tobytes()],
                "dim": pa.array([matrix.shape[1]], pa.int32()),
                "width": pa.array([width], pa.int32()),
                "q": [matrix[order].astype(f"<i{width}").tobytes()],
            })
            number += 1


def _block(row: dict):
    """ids with a sign of NULL, labels and matrix of a block."""
    ids = pa.array(row["ids"], pa.int64())
    labels = np.frombuffer(row["labels"], "<i8")
    matrix = np.frombuffer(row["q"], f"<i{row['width']}").reshape(len(labels), row["dim"])
    return ids, labels, matrix


def _key(block: int, place: np.ndarray) -> np.ndarray:
    return block * BLOCK + place


def _anchors(every: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, matrix = _block(row)
                valid = np.asarray(ids.is_valid())
                at = np.flatnonzero(valid & (np.asarray(ids.fill_null(1)) % every == 0))
                for s in range(0, len(at), 1024):
                    own = at[s : s + 1024]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(_key(row["block"], own)), ids.take(pa.array(own)), pa.array(labels[own]),
                            pa.array(np.full(len(own), row["dim"], np.int32)),
                            pa.array(matrix[own].astype(np.int64).tolist(), pa.list_(pa.int64())),
                        ],
                        ["key", "anchor_id", "label", "dim", "q"],
                    )

    return run


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of integer matrices, held within +-SCORE_LIMIT."""
    dim = max(anchors.shape[1], rows.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (anchors, rows))
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        exact = a.astype(np.int64) @ b.astype(np.int64).T
    else:
        exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -SCORE_LIMIT, SCORE_LIMIT).astype(np.int64)


def first_of_each(owner: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first ``k`` of each owner, by score descending and place ascending."""
    order = np.lexsort((place, -score, owner))
    sorted_owner = owner[order]
    start = np.flatnonzero(np.append(True, sorted_owner[1:] != sorted_owner[:-1])) if len(order) else order
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[rank < k]


def _compared(block: dict, anchors: pa.Table, choose):
    """``choose`` on the scores of a tile of anchors with all rows of the block."""
    ids, labels, rows = _block(block)
    step = max(1, TILE // max(1, len(labels)))
    for start in range(0, anchors.num_rows, step):
        tile = anchors.slice(start, step)
        keys = np.asarray(tile["key"])
        dim = int(np.asarray(tile["dim"]).max())
        own = tile["q"].combine_chunks()
        matrix = np.zeros((len(keys), dim), np.int64)
        lengths = np.asarray(own.value_lengths()).astype(np.int64)
        owner = np.repeat(np.arange(len(keys)), lengths)
        matrix[owner, np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(own.flatten())
        score = scores_of(matrix, rows)
        same = np.asarray(tile["label"])[:, None] == labels[None, :]
        anchor, slot, place = choose(tile, keys, score, same, _key(block["block"], np.arange(len(labels))))
        yield pa.table({
            "key": pa.array(keys[anchor]), "slot": pa.array(slot.astype(np.int32)),
            "score": pa.array(score[anchor, place]), "id": ids.take(pa.array(place)),
        })


FOUND = "key long, slot int, score long, id long"


def _pairwise(choose):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"key": pa.array([], pa.int64()), "slot": pa.array([], pa.int32()), "score": pa.array([], pa.int64()), "id": pa.array([], pa.int64())})
        if not (left.num_rows and right.num_rows):
            return empty
        return pa.concat_tables([empty, *(t for block in left.to_pylist() for t in _compared(block, right, choose))])

    return run


def _choose_positives(k: int):
    def choose(tile, keys, score, same, row_keys):
        wanted = same & (keys[:, None] != row_keys[None, :])
        anchor, place = np.nonzero(wanted)
        best = first_of_each(anchor, score[anchor, place], place, k)
        return anchor[best], np.zeros(len(best), np.int32), place[best]

    return choose


def _choose_slots(k: int, low: int):
    def choose(tile, keys, score, same, row_keys):
        limits = tile["limits"].to_pylist()  # of each anchor, falling
        m = max(map(len, limits))
        upper = np.array([x + [x[-1]] * (m - len(x)) for x in limits], np.int64)
        last = upper[:, -1]
        wanted = ~same & (score <= upper[:, :1]) & (100 * score >= low * last[:, None])
        anchor, place = np.nonzero(wanted)
        found = score[anchor, place]
        # The slot is that of the smallest limit that is not below the score.
        slot = np.minimum((upper[anchor] >= found[:, None]).sum(axis=1), np.array([len(x) for x in limits])[anchor]) - 1
        best = first_of_each(anchor * m + slot, found, place, k)
        return anchor[best], slot[best], place[best]

    return choose


def _in_pairs(blocks: DataFrame, anchors: DataFrame, slices: int, groups: int, choose) -> DataFrame:
    """All blocks with all groups of anchors; each pair is one task's work of bounded size."""

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = blocks.select("*", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), every(groups).alias("team"))
    right = anchors.select("*", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int").alias("team"), every(slices).alias("slice"))
    return left.groupBy("slice", "team").cogroup(right.groupBy("slice", "team")).applyInArrow(_pairwise(choose), FOUND)


def _first_rows(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _merge(k: int, low: int):
    """Rows (anchor_id, positives, found by slot) as the mined negatives."""

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")}
            for row in batch.to_pylist():
                slots: dict[int, list] = {}
                for x in row["found"]:
                    slots.setdefault(x["slot"], []).append((-x["score"], x["id"] is None, x["id"] or 0))
                positives = sorted(row["positives"], key=lambda x: x["place"])
                merged, answers = [], {}
                for j in range(len(positives) - 1, -1, -1):
                    # A slot is numbered by the last of the positives that share its limit.
                    merged = sorted(merged + slots.get(j, []))[:k]
                    answers[j] = merged
                for j, positive in enumerate(positives):
                    p = positive["score"]
                    inside = [x for x in answers[j] if low * p <= -100 * x[0] <= 100 * p]
                    for rank, (minus, missing, own) in enumerate(inside, 1):
                        for name, value in zip(out, (row["anchor_id"], positive["id"], rank, None if missing else own, p, -minus)):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, pa.int32() if n == "rank" else pa.int64()) for n, v in out.items()], list(out)
            )

    return run


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 80
) -> DataFrame:
    """Hard negatives of all rows (vec_id, label, embedding) whose vec_id is divisible by ``every``."""
    packed = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    blocks, _ = write_table(packed.mapInArrow(_pack_blocks, BLOCKS), "vector-blocks")
    anchors, _ = write_table(blocks.mapInArrow(_anchors(every), ANCHORS), "anchors")
    # About one block a slice, so that the keys need no list of blocks.
    slices, groups = max(1, blocks.count()), -(-max(1, anchors.count()) // GROUP)
    near = _first_rows(_in_pairs(blocks, anchors, slices, groups, _choose_positives(positives)), ["key"], positives)
    of_anchor = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "score", "id"))).alias("positives"))
    limited, _ = write_table(
        anchors.join(of_anchor, "key").withColumn("limits", F.transform("positives", lambda x: x["score"])), "limited-anchors"
    )
    found = _first_rows(_in_pairs(blocks, limited, slices, groups, _choose_slots(negatives, low)), ["key", "slot"], negatives)
    slots = found.groupBy("key").agg(F.collect_list(F.struct("slot", "score", "id")).alias("found"))
    return (
        limited.select("key", "anchor_id", "positives").join(slots, "key")
        .select("anchor_id", "positives", "found").mapInArrow(_merge(negatives, low), MINED)
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, own = F.col("label").cast("long"), F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(own % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), "embedding"
    )
    return mine(rows)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.r AS r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS id, a.label = b.label AS same,
    list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v AS a JOIN v AS b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT r, anchor_id, other, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.id NULLS LAST)::INTEGER AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives AS p JOIN scores AS n ON n.r = p.r AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.id NULLS LAST) <= 5
"""
