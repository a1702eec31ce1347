"""Hierarchical Pitman-Yor language model of words, trained and applied on Spark.

Every word w seen after a context u sits as customers in u's Chinese restaurant;
each table of a context restaurant sends one customer to the parent restaurant that
all contexts share, whose base is uniform over the known words and one unknown word.

Work is dealt out in packed pieces, never by token:

1. Documents fill *blocks* of about ``BLOCK`` tokens. A block asks the *vocabulary*
   buckets once for each of its distinct words and gets an id and the training count.
2. A block sends each distinct pair (u, w) once to a *restaurant* bucket, with its
   training count and, for scoring, the documents it stands in. A context belongs to
   one bucket; a context with more than its share of the corpus is split by word, and
   only its table total (one number for each such context, at most two for each
   bucket) is shared through the driver, after the first seating and after each sweep. A frequent pair costs one entry for each
   block that has it, and a document at most one entry for each of its pairs.
3. Buckets seat their customers, and send tables per word to *parent* buckets, which
   seat theirs by Gibbs sampling and answer each bucket for its own words.
4. Buckets re-seat given the parent's samples, average the predictive probability over
   them and return one partial log score for each document of a block.

Seating: given all else, only the number of tables t of a dish matters. It is drawn anew
for all customers of a dish at once (the block Gibbs step): from its exact distribution, which
counts the ways to seat them, up to ``EXACT`` customers; beyond, from that distribution at the saddle
points of its generating function. Large dishes that expect fewer than ``MANY`` tables, where those
are rough, seat customers in runs of an eighth of those present, and Metropolis-Hastings corrects
the chances of that draw. The steps of a dish grow with the logarithm of its size at most. Dishes of one sweep
see the table totals of the sweep before; the parent's are summed over its buckets
between sweeps. ``SAMPLES`` samples are averaged, after one sweep of the parent and one of
the leaves that only leave the start behind.

Discounts come from the counts of counts, the leaf concentration is drawn from its
posterior on a grid. Draws are seeded by bucket, so a task run again agrees with itself.

Defined results: NULL text is empty; an empty text is the end token alone; a NULL
doc_id is in the training part and stays NULL; rows with equal ids are scored each on
its own; an empty table gives an empty result; without training rows every probability
is the uniform base. Word keys are 64-bit hashes.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.blocks import BLOCK, BLOCKS, by_bucket, range_bucket, runs
from wardledger.llm.blocks import blocks as pack_blocks
from wardledger.llm.shared import (
    drop_tables,
    fold_of_id,
    mix,
    pack,
    shuffle_partitions,
    table,
    unpack,
    write_table,
)

SAMPLES = 2
DRAWS = 4
EXACT = 64
RUN = 8
MANY = 8
POINTS = 65
THETAS = tuple(0.25 * 2.0**k for k in range(12))
RESULT = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
    "base_score double, score double"
)


# ---- 1. blocks and vocabulary ---------------------------------------------------------


def _training(row) -> np.ndarray:
    """For each token of a block whether its document trains."""
    return np.repeat(~np.array(row["held"], bool), unpack(row["lengths"]))


def _vocabulary_requests(buckets):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                hashes = unpack(row["hashes"])
                tokens = unpack(row["tokens"])
                counts = np.bincount(tokens[_training(row)], minlength=len(hashes))[unpack(row["numbers"])]
                _, parts = by_bucket(range_bucket(hashes, buckets))
                yield pa.RecordBatch.from_pydict({
                    "bucket": [b for b, _, _ in parts],
                    "block": [row["block"]] * len(parts),
                    "keys": [pack(hashes[i:j]) for _, i, j in parts],
                    "counts": [pack(counts[i:j]) for _, i, j in parts],
                })

    return run


def _vocabulary(buckets, frequent):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        keys = [unpack(r["keys"]) for r in rows]
        found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        parts = np.concatenate([unpack(r["counts"]) for r in rows])
        counts = np.bincount(inverse, parts, len(found)).astype(np.int64)
        ids = np.arange(len(found), dtype=np.int64) * buckets + rows[0]["bucket"]
        ends = np.cumsum([len(k) for k in keys])
        slices = [inverse[e - len(k) : e] for k, e in zip(keys, ends)]
        hot = np.flatnonzero(counts > frequent)
        once = {"known": int((counts > 0).sum()), "n1": int((counts == 1).sum()), "n2": int((counts == 2).sum())}
        n = len(rows)
        return pa.table({
            "block": [r["block"] for r in rows],
            "bucket": [r["bucket"] for r in rows],
            "ids": [pack(ids[s]) for s in slices],
            "counts": [pack(counts[s]) for s in slices],
            **{k: [v] + [0] * (n - 1) for k, v in once.items()},
            "hot": pa.array([ids[hot].tolist()] + [[]] * (n - 1), pa.list_(pa.int64())),
            "hot_counts": pa.array([counts[hot].tolist()] + [[]] * (n - 1), pa.list_(pa.int64())),
        })

    return run


VOCABULARY = (
    "block long, bucket long, ids binary, counts binary, known long, n1 long, n2 long, "
    "hot array<long>, hot_counts array<long>"
)


# ---- 2. pairs ------------------------------------------------------------------------

#: The context of a document's first word, which no word's id reaches.
START = (1 << 63) - 1


def _pairs(buckets, hot_ids):
    """A block and its vocabulary answers -> one row of base scores, and pieces for buckets."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        numbers = unpack(row["numbers"])
        answers = sorted(right.select(["bucket", "ids", "counts"]).to_pylist(), key=lambda r: r["bucket"])
        ids = np.empty(len(numbers), np.int64)
        counts = np.empty(len(numbers), np.int64)
        ids[numbers] = np.concatenate([unpack(r["ids"]) for r in answers])
        counts[numbers] = np.concatenate([unpack(r["counts"]) for r in answers])
        tokens, lengths = unpack(row["tokens"]), unpack(row["lengths"]).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        count = counts[tokens]
        base = np.add.reduceat(np.log10(count + 0.5), starts)
        known = np.add.reduceat((count > 0).astype(np.int64), starts)
        out = {k: [] for k in ("bucket", "block", "u", "w", "c", "entries", "docs", "times", "base")}

        w = ids[tokens]
        u = np.empty_like(w)
        u[1:] = w[:-1]
        u[starts] = START
        doc = np.repeat(np.arange(len(lengths)), lengths)
        if len(hot_ids):
            split = np.isin(u, hot_ids)
        else:
            split = np.zeros(len(u), bool)
        place = mix(np.where(split, u * 31 + w + 1, u)) % np.uint64(buckets)
        order = np.lexsort((w, u, place))
        place, u, w, doc, trains = place[order], u[order], w[order], doc[order], _training(row)[order]
        entry = runs(u, w, doc)
        times = np.diff(np.append(entry, len(u)))
        pair = runs(u, w)
        per_pair = np.diff(np.append(np.searchsorted(entry, pair), len(entry)))
        c = np.add.reduceat(trains.astype(np.int64), pair)
        at = np.append(0, np.cumsum(per_pair))
        bounds = runs(place[pair])
        for i, j in zip(bounds, np.append(bounds[1:], len(pair))):
            e = slice(at[i], at[j])
            out["bucket"].append(int(place[pair[i]]))
            out["u"].append(pack(u[pair[i:j]]))
            out["w"].append(pack(w[pair[i:j]]))
            out["c"].append(pack(c[i:j]))
            out["entries"].append(pack(per_pair[i:j]))
            out["docs"].append(pack(doc[entry[e]]))
            out["times"].append(pack(times[e]))
            out["base"].append(None)
        out["bucket"].append(-1 - row["block"])
        for k in ("u", "w", "c", "entries", "docs", "times"):
            out[k].append(None)
        out["base"].append([
            {"doc_id": d, "held": h, "n": n, "known": k, "base": s}
            for d, h, n, k, s in zip(row["ids"], row["held"], lengths.tolist(), known.tolist(), base.tolist())
        ])
        out["block"] = [row["block"]] * len(out["bucket"])
        return pa.Table.from_pydict(out, schema=PIECES_ARROW)

    return run


BASE = "array<struct<doc_id:long,held:boolean,n:long,known:long,base:double>>"
PIECES = (
    "bucket long, block long, u binary, w binary, c binary, entries binary, docs binary, "
    f"times binary, base {BASE}"
)
_BASE_ARROW = pa.list_(pa.struct({
    "doc_id": pa.int64(), "held": pa.bool_(), "n": pa.int64(), "known": pa.int64(), "base": pa.float64()
}))
PIECES_ARROW = pa.schema([
    ("bucket", pa.int64()), ("block", pa.int64()),
    *((k, pa.binary()) for k in ("u", "w", "c", "entries", "docs", "times")), ("base", _BASE_ARROW),
])

RESTAURANTS = (
    "bucket long, u binary, w binary, c binary, n1 long, n2 long, "
    f"blocks array<long>, pieces array<struct<at:binary,entries:binary,docs:binary,times:binary>>, base {BASE}"
)


def _restaurants(group: pa.Table) -> pa.Table:
    """All pieces of a bucket as one row; a block's base scores pass through."""
    rows = group.to_pylist()
    empty = {"u": b"", "w": b"", "c": b"", "n1": 0, "n2": 0, "pieces": []}
    if rows[0]["bucket"] < 0:
        made = [{"bucket": r["bucket"], "blocks": [r["block"]], "base": r["base"], **empty} for r in rows]
        return pa.Table.from_pylist(made, schema=RESTAURANTS_ARROW)
    u = np.concatenate([unpack(r["u"]).astype(np.int64) for r in rows])
    w = np.concatenate([unpack(r["w"]).astype(np.int64) for r in rows])
    c = np.concatenate([unpack(r["c"]).astype(np.int64) for r in rows])
    order = np.lexsort((w, u))
    first = runs(u[order], w[order])
    inverse = np.empty(len(u), np.int64)
    mark = np.zeros(len(u), np.int64)
    mark[first[1:]] = 1
    inverse[order] = np.cumsum(mark)
    total = np.add.reduceat(c[order], first)
    pieces, at = [], 0
    for r in rows:
        n = len(unpack(r["u"]))
        own = inverse[at : at + n]
        at += n
        pieces.append({"at": pack(np.diff(own, prepend=0)), **{k: r[k] for k in ("entries", "docs", "times")}})
    made = {
        "bucket": rows[0]["bucket"], "u": pack(u[order][first]), "w": pack(w[order][first]), "c": pack(total),
        "n1": int((total == 1).sum()), "n2": int((total == 2).sum()),
        "blocks": [r["block"] for r in rows], "pieces": pieces, "base": None,
    }
    return pa.Table.from_pylist([made], schema=RESTAURANTS_ARROW)


RESTAURANTS_ARROW = pa.schema([
    ("bucket", pa.int64()), ("u", pa.binary()), ("w", pa.binary()), ("c", pa.binary()),
    ("n1", pa.int64()), ("n2", pa.int64()), ("blocks", pa.list_(pa.int64())),
    ("pieces", pa.list_(pa.struct({k: pa.binary() for k in ("at", "entries", "docs", "times")}))),
    ("base", _BASE_ARROW),
])


# ---- 3. seating ----------------------------------------------------------------------


def _log_rise(x, m):
    """log of x (x+1) ... (x+m-1) for x of some size, by Stirling's series."""

    def g(v):
        return (v - 0.5) * np.log(v) - v + 1 / (12 * v)

    return g(x + m) - g(x)


def _log_ways(d):
    """Row c: log of the ways to seat c customers at 1, 2, ... tables, up to ``EXACT`` customers."""
    ways = np.full((EXACT + 1, EXACT), -np.inf)
    ways[1, 0] = 0.0
    tables = np.arange(1, EXACT + 1)
    for n in range(1, EXACT):
        ways[n + 1] = ways[n] + np.log(np.maximum(n - d * tables, 1e-300))
        ways[n + 1, 1:] = np.logaddexp(ways[n + 1, 1:], ways[n, :-1])
    return ways


def _seat_few(rng, c, others, p, d):
    """Tables of dishes of at most ``EXACT`` customers, from their exact distribution."""
    t = np.ones(len(c))
    ways = _log_ways(d)
    order = np.argsort(c, kind="stable")
    ends = np.searchsorted(c[order], np.arange(EXACT + 1), side="right")
    for size in range(2, EXACT + 1):
        for i in range(ends[size - 1], ends[size], 4096):
            at = order[i : min(i + 4096, ends[size])]
            logs = np.zeros((len(at), size))
            np.cumsum(np.log((others[at, None] + d * np.arange(1, size)) * p[at, None]), axis=1, out=logs[:, 1:])
            logs += ways[size, :size]
            logs -= logs.max(axis=1, keepdims=True)
            sums = np.cumsum(np.exp(logs), axis=1)
            t[at] += (sums < (rng.random(len(at)) * sums[:, -1])[:, None]).sum(axis=1)
    return t


def _expected(c, rate, d):
    """About how many tables c customers take that open new ones at ``rate``."""
    return np.minimum(rate / d * -np.expm1(-d * np.log1p(c / np.maximum(rate, 1e-300))), c)


def _seat_many(rng, c, others, p, d):
    """Seat the customers of each dish run by run: tables, and log weight of the draw.

    A run is an eighth of those present (one customer at first) and opens tables with the
    chance in its middle. A table opened now lowers all later normalisers by d (1 - p); the
    chance takes that in, as if they grew evenly to the last, so that draws come close to the
    wanted distribution. The weight is the
    probability of a seating over that of drawing it, up to a constant.
    """
    t = np.ones(len(c))
    weight = np.zeros(len(c))
    rate = others * p
    last = rate + c - d * (1 - p) * _expected(c, rate, d)  # the normaliser of the last customer
    live, n = np.arange(len(c)), 1
    while len(live):
        step = max(n // RUN, 1)
        m = np.minimum(step, c[live] - n)
        before, rest, base = t[live], others[live], p[live]

        def at(tables):
            """Weights of a new table and of all old ones for the customer in the middle."""
            return np.maximum((rest + d * tables) * base, 1e-300), np.maximum(n + (m - 1) / 2 - d * tables, 1e-9)

        def chance(tables):
            new, stay = at(tables)
            z = new + stay
            slope = np.clip((last[live] - z) / np.maximum(c[live] - n, 1), 1 - d, 1.0)
            new = new * np.minimum(z / last[live], 1.0) ** (d * (1 - base) / slope)
            return new / (new + stay)

        opens = chance(before + (m - 1) / 2 * chance(before))
        opened = rng.binomial(m.astype(np.int64), opens)
        new, stay = at(before + np.maximum(opened - opened / m, 0) / 2)
        weight[live] += opened * np.log(new / opens) + (m - opened) * np.log(stay / np.maximum(1 - opens, 1e-300))
        t[live] += opened
        n += step
        live = live[c[live] > n]
    return t, weight


def _log_gamma(x):
    """By Stirling's series, from x + 6 down, for x >= 0.5."""
    z = x + 6
    down = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) - down


def _saddle(c, u, d):
    """The number of tables whose ways have their saddle point at 1 - exp(-exp(u)), and the log of the ways.

    The ways to seat c customers at t tables are c! / t! times the coefficient of x^c in
    ((1 - (1 - x)^d) / d)^t; factors of c alone are left out.
    """
    low = -np.exp(u)
    x, rest = -np.expm1(low), -np.expm1(d * low)
    slope = d * x * np.exp((d - 1) * low) / rest
    bend = np.maximum(slope * (1 + (1 - d) * x * np.exp(-low) - slope), 1e-12)
    t = c / slope
    return t, t * np.log(rest / d) - c * np.log(x) - _log_gamma(t + 1) - 0.5 * np.log(t * bend)


def _seat_tables(rng, c, others, p, d):
    """Tables of dishes of many customers and many tables, from the distribution at its saddle points.

    The distribution has one peak; it is taken at ``POINTS`` places within eight deviations of
    the peak and drawn from by its sums.
    """

    def where(rising):
        """The place up to which ``rising`` holds, by halving; tables fall with the place."""
        low, high = np.full(len(c), -25.0), np.full(len(c), 4.0)
        for _ in range(50):
            middle = (low + high) / 2
            up = rising(middle)
            low, high = np.where(up, low, middle), np.where(up, middle, high)
        return (low + high) / 2

    def slope(u):
        t = _saddle(c, u, d)[0]
        return t, np.log((others + d * t) * p / t) + np.log(-np.expm1(-d * np.exp(u)) / d)

    peak = where(lambda u: slope(u)[1] >= 0)
    near, far = slope(peak - 0.01), slope(peak + 0.01)
    width = np.sqrt(np.maximum((near[0] - far[0]) / np.maximum(far[1] - near[1], 1e-300), 0.01))
    t = _saddle(c, peak, d)[0]
    ends = [where(lambda u, x=x: x >= _saddle(c, u, d)[0]) for x in (np.maximum(t - 8 * width, 0.5), np.minimum(t + 8 * width, c))]
    u = ends[1][:, None] + (ends[0] - ends[1])[:, None] * np.linspace(1, 0, POINTS)
    t, logs = _saddle(c[:, None], u, d)
    logs += (t - 1) * np.log(p * d)[:, None] + _log_gamma(others[:, None] / d + t)
    mass = np.exp(logs - logs.max(axis=1, keepdims=True))
    sums = np.zeros(t.shape)
    np.cumsum((mass[:, 1:] + mass[:, :-1]) / 2 * np.diff(t, axis=1), axis=1, out=sums[:, 1:])
    pick = rng.random(len(c)) * sums[:, -1]
    cell = np.minimum((sums[:, 1:] <= pick[:, None]).sum(axis=1), POINTS - 2)
    row = np.arange(len(c))
    part = (pick - sums[row, cell]) / np.maximum(sums[row, cell + 1] - sums[row, cell], 1e-300)
    drawn = t[row, cell] + part * (t[row, cell + 1] - t[row, cell])
    return np.clip(np.rint(drawn), 1, c)


def reseat(rng, c, others, p, d, draws=DRAWS):
    """Tables of each dish, drawn given the tables of all others in its restaurant.

    ``others``: concentration plus discount times those tables; ``p``: the parent's
    probability. Dishes of up to ``EXACT`` customers are drawn from the exact distribution, larger
    ones that expect many tables from its saddle points, and those that expect few by ``draws``
    seatings in turn, each accepted by Metropolis-Hastings. Dishes of one customer have one table.
    """
    few = c <= EXACT
    t = np.ones(len(c))
    t[few] = _seat_few(rng, c[few], others[few], p[few], d)
    many = ~few & (_expected(c, others * p, d) > MANY)
    for i in range(0, len(places := np.flatnonzero(many)), 4096):
        at = places[i : i + 4096]
        t[at] = _seat_tables(rng, c[at], others[at], p[at], d)
    left = np.flatnonzero(~few & ~many)
    args = (c[left], others[left], p[left], d)
    seated, weight = _seat_many(rng, *args)
    for _ in range(draws - 1):
        again, other = _seat_many(rng, *args)
        take = np.log(rng.random(len(left))) < other - weight
        seated, weight = np.where(take, again, seated), np.where(take, other, weight)
    t[left] = seated
    return t


class _Bucket:
    """The restaurants of one bucket."""

    def __init__(self, row, hot):
        self.u, self.w = (unpack(row[k]).astype(np.int64) for k in ("u", "w"))
        self.c = unpack(row["c"]).astype(np.float64)
        first = runs(self.u)
        self.context = np.zeros(len(self.u), np.int64)
        self.context[first[1:]] = 1
        self.context = np.cumsum(self.context)
        self.names = self.u[first]
        self.customers = np.bincount(self.context, self.c)
        self.hot = {int(i): hot[int(n)] for i, n in enumerate(self.names) if int(n) in hot} if hot else {}
        self.scale = np.ones(len(first))
        for i, (customers, _) in self.hot.items():
            self.scale[i] = customers / max(self.customers[i], 1.0)
            self.customers[i] = customers
        self.dishes, self.dish = np.unique(self.w, return_inverse=True)
        self.t = np.minimum(self.c, 1.0)
        self.split = np.isin(self.context, list(self.hot))

    def share(self, tables):
        """Take over the summed table totals of contexts split over buckets."""
        self.hot = {i: (c, tables[int(self.names[i])]) for i, (c, _) in self.hot.items()}

    def tables(self):
        """Tables of each context; of one split over buckets, the shared total if it is known."""
        total = np.bincount(self.context, self.t) * self.scale
        for i, (_, tables) in self.hot.items():
            if tables is not None:
                total[i] = tables
        return total

    def sweep(self, rng, p, theta, d, some=True):
        many = np.flatnonzero((self.c > 1) & some)
        others = theta + d * np.maximum(self.tables()[self.context[many]] - self.t[many], 0)
        self.t[many] = reseat(rng, self.c[many], others, p[many], d)

    def predict(self, p, theta, d):
        back = (theta + d * self.tables()[self.context]) * p
        return (np.maximum(self.c - d * self.t, 0) + back) / (theta + self.customers[self.context])


def _leaf_to_parent(buckets, hot, theta, d, vocabulary):
    """First seating; tables per word to the parent buckets, and sums for the concentration."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bucket = _Bucket(row, hot)
                rng = np.random.default_rng([1, row["bucket"]])
                near = np.bincount(bucket.dish, bucket.c)
                p = ((near + 0.5) / (near.sum() + 0.5 * (vocabulary + 1)))[bucket.dish]
                bucket.sweep(rng, p, theta, d)
                tables = bucket.tables()
                whole = np.ones(len(tables), bool)
                whole[list(bucket.hot)] = False
                grid = [_restaurant_log(tables[whole], bucket.customers[whole], x, d) for x in THETAS]
                customers = np.bincount(bucket.dish, bucket.t).astype(np.int64)
                order, parts = by_bucket(bucket.dishes % buckets)
                local = np.bincount(bucket.context, bucket.t)
                n = len(parts)
                yield pa.RecordBatch.from_pydict({
                    "parent": pa.array([b for b, _, _ in parts], pa.int64()),
                    "bucket": pa.array([row["bucket"]] * n, pa.int64()),
                    "w": [pack(bucket.dishes[order[i:j]]) for _, i, j in parts],
                    "customers": [pack(customers[order[i:j]]) for _, i, j in parts],
                    "grid": pa.array([grid] + [None] * (n - 1), pa.list_(pa.float64())),
                    "hot": pa.array([[int(bucket.names[i]) for i in bucket.hot]] + [None] * (n - 1), pa.list_(pa.int64())),
                    "hot_tables": pa.array([[float(local[i]) for i in bucket.hot]] + [None] * (n - 1), pa.list_(pa.float64())),
                })

    return run


def _split_logs(hot, d):
    """The part of contexts split over buckets in the grid, each once from its summed tables."""
    known = [(tables, customers) for customers, tables in hot.values() if tables is not None]
    tables, customers = (np.array([x[k] for x in known], np.float64) for k in (0, 1))
    return np.array([_restaurant_log(tables, customers, x, d) for x in THETAS])


def _restaurant_log(tables, customers, theta, d):
    """Log probability of the table counts and customers as far as it depends on theta."""
    some = customers > 0
    t, c = tables[some], customers[some]
    return float(np.sum(t * math.log(d) + _log_rise(np.full(len(t), theta / d + 1), t - 1) - _log_rise(np.full(len(c), theta + 1), c - 1)))


TO_PARENT = (
    "parent long, bucket long, w binary, customers binary, grid array<double>, "
    "hot array<long>, hot_tables array<double>"
)


def _customers(rows):
    """Words of each row, all words, which of them each is, and the customers of each."""
    w = [unpack(r["w"]).astype(np.int64) for r in rows]
    found, inverse = np.unique(np.concatenate(w), return_inverse=True)
    return w, inverse, np.bincount(inverse, np.concatenate([unpack(r["customers"]) for r in rows]), len(found))


def _parent_customers(group: pa.Table) -> pa.Table:
    rows = group.to_pylist()
    return pa.table({"parent": [rows[0]["parent"]], "customers": [pack(_customers(rows)[2].astype(np.int64))]})


def _parent_sweeps(c, number, d, theta, base, totals):
    """Tables per word after each sweep; ``totals``: those of all buckets before each."""
    rng = np.random.default_rng([2, number])
    t = np.minimum(c, 1.0)
    many = np.flatnonzero(c > 1)
    for total in totals:
        others = theta + d * np.maximum(total - t[many], 0)
        t[many] = reseat(rng, c[many], others, np.full(len(many), base), d)
        yield t


def _parent_tables(d, theta, base, totals):
    """Tables of a bucket after the last sweep."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                *_, t = _parent_sweeps(unpack(row["customers"]).astype(np.float64), row["parent"], d, theta, base, totals)
                yield pa.RecordBatch.from_pydict({"tables": pa.array([t.sum()], pa.float64())})

    return run


def _parent_totals(sent, d, theta, base, start):
    """Tables of all the parent's buckets before each of its sweeps; ``start``: before the first."""
    counts, path = write_table(
        sent.select("parent", "w", "customers").groupBy("parent")
        .applyInArrow(_parent_customers, "parent long, customers binary"),
        "lm-parent-customers",
    )
    totals = [start]
    for _ in range(SAMPLES):
        after = counts.mapInArrow(_parent_tables(d, theta, base, list(totals)), "tables double")
        totals.append(after.agg(F.coalesce(F.sum("tables"), F.lit(0.0))).first()[0])
    drop_tables(sent.sparkSession, path)
    return totals


def _parent(d, theta, base, before):
    """Gibbs samples of the parent restaurant, answered to each bucket for its own words."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        w, inverse, c = _customers(rows)
        left, totals = [], []
        for sample, t in enumerate(_parent_sweeps(c, rows[0]["parent"], d, theta, base, before)):
            if sample:  # the first sweep only leaves the start behind
                left.append(np.maximum(c - d * t, 0))
                totals.append(float(t.sum()))
        ends = np.cumsum([len(x) for x in w])
        answers = [np.stack([x[inverse[e - len(k) : e]] for x in left]) for k, e in zip(w, ends)]
        n = len(rows)
        return pa.table({
            "bucket": [r["bucket"] for r in rows],
            "parent": [r["parent"] for r in rows],
            "left": [a.astype("<f4").tobytes() for a in answers],
            "customers": [float(c.sum())] + [0.0] * (n - 1),
            "tables": pa.array([totals] + [[0.0] * SAMPLES] * (n - 1), pa.list_(pa.float64())),
        })

    return run


FROM_PARENT = "bucket long, parent long, left binary, customers double, tables array<double>"


# ---- 4. scores -----------------------------------------------------------------------

#: The parent's sample that each sweep of the leaves uses; the first sweep is not averaged.
SWEEPS = (0, *range(SAMPLES))
#: Partial scores are whole numbers of this fraction, so that they add without rounding.
UNIT = float(1 << 24)
HOT = "bucket long, u binary, w binary, c binary, at binary"


def _hot_pairs(buckets, hot_ids):
    """Pairs of split contexts of a bucket, and where the answers for their words stand."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u, w, c = (unpack(row[k]).astype(np.int64) for k in ("u", "w", "c"))
                some = np.isin(u, hot_ids)
                if some.any():
                    dishes, dish = np.unique(w, return_inverse=True)
                    order, _ = by_bucket(dishes % buckets)
                    rank = np.empty_like(order)
                    rank[order] = np.arange(len(order))
                    yield pa.RecordBatch.from_pydict({
                        "bucket": pa.array([row["bucket"]], pa.int64()), "u": [pack(u[some])], "w": [pack(w[some])],
                        "c": [pack(c[some])], "at": [pack(rank[dish[some]])],
                    })

    return run


def _hot_answers(left: pa.Table, right: pa.Table) -> pa.Table:
    """The parent's samples for each pair of split contexts."""
    answers = sorted(right.select(["parent", "left"]).to_pylist(), key=lambda r: r["parent"])
    rows = left.to_pylist()
    if rows:
        samples = np.concatenate([np.frombuffer(r["left"], "<f4").reshape(SAMPLES, -1) for r in answers], axis=1)
    return pa.table({
        "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
        **{k: pa.array([r[k] for r in rows], pa.binary()) for k in ("u", "w", "c")},
        "left": pa.array([samples[:, unpack(r["at"])].tobytes() for r in rows], pa.binary()),
    })


def _split_sweep(hot, k, theta, d, customers, shares):
    """Sweep ``k`` of the pairs of split contexts; a row takes its tables along to the next."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bucket = _Bucket(row, hot)
                if row["tables"]:
                    bucket.t = unpack(row["tables"][-1]).astype(np.float64)
                s = SWEEPS[k]
                word = np.frombuffer(row["left"], "<f4").reshape(SAMPLES, -1)[s].astype(np.float64)
                rng = np.random.default_rng([4, row["bucket"], k])
                bucket.sweep(rng, (word + shares[s]) / customers, theta, d)
                row["tables"] = [*row["tables"], pack(bucket.t.astype(np.int64))]
                row["names"] = bucket.names.tolist()
                row["totals"] = np.bincount(bucket.context, bucket.t).tolist()
                yield pa.RecordBatch.from_pylist([row], schema=SPLIT_ARROW)

    return run


SPLIT = (
    "bucket long, u binary, w binary, c binary, left binary, tables array<binary>, "
    "names array<long>, totals array<double>"
)
SPLIT_ARROW = pa.schema([
    ("bucket", pa.int64()), *((k, pa.binary()) for k in ("u", "w", "c", "left")),
    ("tables", pa.list_(pa.binary())), ("names", pa.list_(pa.int64())), ("totals", pa.list_(pa.float64())),
])


def _split_sweeps(restaurants, answers, buckets, hot, *model):
    """Tables of the pairs of split contexts after each of ``SWEEPS``, and the summed tables.

    Each sweep is done once, a bucket a row and its tables written; the next one starts there,
    with the totals over all buckets. Without split contexts: no rows.
    """
    spark = restaurants.sparkSession
    if not hot:
        return spark.createDataFrame([], "bucket long, tables array<binary>"), [{} for _ in SWEEPS]
    pairs = restaurants.where("bucket >= 0").select("bucket", "u", "w", "c").mapInArrow(
        _hot_pairs(buckets, np.array(sorted(hot), np.int64)), HOT
    )
    seats = (
        pairs.groupBy("bucket").cogroup(answers.select("bucket", "parent", "left").groupBy("bucket"))
        .applyInArrow(_hot_answers, "bucket long, u binary, w binary, c binary, left binary")
        .withColumn("tables", F.array().cast("array<binary>"))
    )
    totals, last = [], None
    for k in range(len(SWEEPS)):
        # A key and a number keep adaptive execution from merging the few large rows into one task.
        dealt = seats.repartition(shuffle_partitions(spark), "bucket")
        seats, path = write_table(dealt.mapInArrow(_split_sweep(hot, k, *model), SPLIT), "lm-split")
        if last:
            drop_tables(spark, last)
        last = path
        found = seats.select(F.explode(F.arrays_zip("names", "totals")).alias("x")).groupBy("x.names")
        totals.append({r["names"]: r["tables"] for r in found.agg(F.sum("x.totals").alias("tables")).collect()})
        hot = {i: (c, totals[-1].get(i)) for i, (c, _) in hot.items()}
        seats = seats.drop("names", "totals")
    return seats.select("bucket", "tables"), totals


def _scores(buckets, hot, theta, d, customers, shares, totals):
    """Partial log scores of the documents of each block.

    ``shares``: what unseen words get; ``totals``: tables of split contexts after each sweep.
    The right side holds the parent's answers, and one row with the tables of a bucket's pairs of
    split contexts after each sweep.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            return pa.Table.from_pylist([], schema=SCORES_ARROW)
        row = left.to_pylist()[0]
        if row["base"] is not None:
            made = [{"block": row["blocks"][0], "base": row["base"], "part": None}]
            return pa.Table.from_pylist(made, schema=SCORES_ARROW)
        bucket = _Bucket(row, hot)
        rng = np.random.default_rng([3, row["bucket"]])
        order, parts = by_bucket(bucket.dishes % buckets)
        found = right.to_pylist()
        answers = {r["parent"]: np.frombuffer(r["left"], "<f4").reshape(SAMPLES, -1) for r in found if r["left"] is not None}
        tables = next((r["tables"] for r in found if r["tables"] is not None), None)
        word = np.empty((SAMPLES, len(bucket.dishes)))
        for b, i, j in parts:
            word[:, order[i:j]] = answers[b]
        mean = np.zeros(len(bucket.c))
        for k, s in enumerate(SWEEPS):
            p = ((word[s] + shares[s]) / customers)[bucket.dish]
            bucket.sweep(rng, p, theta, d, ~bucket.split)
            if bucket.hot:
                bucket.t[bucket.split] = unpack(tables[k])
                bucket.share(totals[k])
            if k:
                mean += bucket.predict(p, theta, d)
        logs = np.log10(mean / SAMPLES)
        made = []
        for block, piece in zip(row["blocks"], row["pieces"]):
            entries, docs = unpack(piece["entries"]).astype(np.int64), unpack(piece["docs"]).astype(np.int64)
            at = np.repeat(np.cumsum(unpack(piece["at"]).astype(np.int64)), entries)
            sums = np.bincount(docs, logs[at] * unpack(piece["times"]))
            made.append({"block": block, "base": None, "part": pack(np.rint(-sums * UNIT).astype(np.int64))})
        return pa.Table.from_pylist(made, schema=SCORES_ARROW)

    return run


SCORES = f"block long, base {BASE}, part binary"
SCORES_ARROW = pa.schema([("block", pa.int64()), ("base", _BASE_ARROW), ("part", pa.binary())])


def _documents(tokens, vocabulary):
    def run(group: pa.Table) -> pa.Table:
        base, total = None, np.zeros(0, np.int64)
        for row in group.to_pylist():
            if row["base"] is not None:
                base = row["base"]
                continue
            part = unpack(row["part"]).astype(np.int64)
            if len(part) > len(total):
                total = np.append(total, np.zeros(len(part) - len(total), np.int64))
            total[: len(part)] += part
        under = math.log10(tokens + 0.5 * (vocabulary + 1))
        return pa.table({
            "doc_id": pa.array([b["doc_id"] for b in base], pa.int64()),
            "held_out": [b["held"] for b in base],
            "n_tokens": [b["n"] for b in base],
            "n_known": [b["known"] for b in base],
            "train_tokens": [tokens] * len(base),
            "base_score": [b["base"] - b["n"] * under for b in base],
            "score": (total[: len(base)] / -UNIT).tolist(),
        })

    return run


def _discount(n1, n2) -> float:
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, seed: int = 7) -> DataFrame:
    """Train on the documents outside ``held_fold`` and score all of them.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, the
    log10 probability of the text and its end; perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    rows = docs.select(
        "doc_id", (fold_of_id(F.col("doc_id"), folds) == held_fold).alias("held"), "text"
    )
    blocks, blocks_path = write_table(rows.mapInArrow(pack_blocks, BLOCKS), "lm-blocks")
    n = blocks.agg(
        F.coalesce(F.sum("trained"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"),
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("all"),
    ).first()
    if not n["all"]:
        return spark.createDataFrame([], RESULT)
    buckets = max(shuffle_partitions(spark), -(-n["tokens"] // BLOCK))
    frequent = n["tokens"] // (2 * buckets)
    vocabulary, vocabulary_path = write_table(
        blocks.mapInArrow(_vocabulary_requests(buckets), "bucket long, block long, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(_vocabulary(buckets, frequent), VOCABULARY),
        "lm-vocabulary",
    )
    drop_tables(spark)  # the shuffle behind the vocabulary
    v = vocabulary.agg(*(F.sum(k).alias(k) for k in ("known", "n1", "n2"))).first()
    # Contexts with more than frequent customers: fewer than two for each bucket.
    hot = {
        i: (c, None)
        for r in vocabulary.where(F.size("hot") > 0).select("hot", "hot_counts").collect()
        for i, c in zip(r["hot"], r["hot_counts"])
    }
    if n["documents"] > frequent:
        hot[START] = (n["documents"], None)
    pieces = (
        blocks.drop("hashes").groupBy("block")
        .cogroup(vocabulary.select("block", "bucket", "ids", "counts").groupBy("block"))
        .applyInArrow(_pairs(buckets, np.array(sorted(hot), np.int64)), PIECES)
    )
    restaurants, restaurants_path = write_table(
        pieces.groupBy("bucket").applyInArrow(_restaurants, RESTAURANTS), "lm-restaurants"
    )
    drop_tables(spark, blocks_path, vocabulary_path)

    seats = restaurants.where("bucket >= 0").agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2")).first()
    d, d_parent = _discount(seats["n1"], seats["n2"]), _discount(v["n1"], v["n2"])
    base = 1.0 / (v["known"] + 1)
    sent, sent_path = write_table(
        restaurants.where("bucket >= 0").select("bucket", "u", "w", "c")
        .mapInArrow(_leaf_to_parent(buckets, hot, 1.0, d, v["known"]), TO_PARENT),
        "lm-tables",
    )
    grid = sent.where("grid IS NOT NULL").agg(*(F.sum(F.col("grid")[k]) for k in range(len(THETAS)))).first()
    shared = (
        sent.where("hot IS NOT NULL").select(F.explode(F.arrays_zip("hot", "hot_tables")).alias("x"))
        .groupBy("x.hot").agg(F.sum("x.hot_tables").alias("tables")).collect()
    )
    tables = {r["hot"]: r["tables"] for r in shared}
    hot = {i: (c, tables.get(i)) for i, (c, _) in hot.items()}
    logs = np.array([x or 0.0 for x in grid]) + _split_logs(hot, d)
    chances = np.exp(logs - logs.max())
    theta = THETAS[np.random.default_rng(seed).choice(len(THETAS), p=chances / chances.sum())]
    before = _parent_totals(sent, d_parent, 1.0, base, v["known"])
    answers, _ = write_table(
        sent.select("parent", "bucket", "w", "customers").groupBy("parent")
        .applyInArrow(_parent(d_parent, 1.0, base, before), FROM_PARENT),
        "lm-parent",
    )
    drop_tables(spark, sent_path)
    sums = answers.agg(
        F.sum("customers").alias("customers"),
        *(F.sum(F.col("tables")[s]).alias(f"t{s}") for s in range(SAMPLES)),
    ).first()
    shares = [(1.0 + d_parent * sums[f"t{s}"]) * base for s in range(SAMPLES)]
    model = (theta, d, 1.0 + sums["customers"], shares)
    seats, totals = _split_sweeps(restaurants, answers, buckets, hot, *model)
    given = answers.select("bucket", "parent", "left").unionByName(seats, allowMissingColumns=True)
    return (
        restaurants.groupBy("bucket").cogroup(given.groupBy("bucket"))
        .applyInArrow(_scores(buckets, hot, *model, totals), SCORES)
        .groupBy("block").applyInArrow(_documents(n["tokens"], v["known"]), RESULT)
    )


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
