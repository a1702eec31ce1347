"""Exact Jaccard join of 5-word shingle sets in metric space, and its link components.

Jaccard distance is a metric, so pivots, Voronoi regions and triangle-inequality windows
apply. Between unrelated texts it is 1, though: any pivot is equally far from nearly every
document, its windows (twice the radius of 0.2) would replicate all of them, and regions
would never shrink. So the join first finds the documents for which a partner is possible
at all, and cuts them into start regions:

1. The number of occurrences of each shingle in the corpus is counted (packed requests of
   blocks, see ``blocks``; 32-bit fingerprints inside a bucket, where a collision can only
   raise a count). Shingles are ordered by (count, hash), rare ones first.
2. If fewer than 80 % of a document's shingles occur twice in the corpus, it has no partner.
   Otherwise its start regions are the shared ones among its first n - ceil(0.8 n) + 1
   shingles: two sets with similarity of 0.8 have one of those in common. Equal sets are
   one class from here on. Regions with the same members are one region.
3. Distances are those of *sketches* (counts in 256 bins), a metric that is at most the
   Jaccard distance, so its windows lose no pair. A pair that its sketches allow is verified
   on the whole sets. Each region takes a pivot, and regions with the same pivot become one,
   which only adds pairs to look at. Members within the radius of the pivot are linked to it, and
   the pivot, which has met every member, leaves. A region is done when links connect all
   that is left of it.
4. Open regions of at most ``SMALL`` members are joined exactly inside a task. Larger ones
   take ``PIVOTS`` pivots and split into their Voronoi regions: a member goes to its nearest
   pivot, and also to every pivot that is at most twice the radius farther away, which by the
   triangle inequality brings each pair of partners together. The regions go back to the start
   of step 4, until none is open; every level takes its pivots out. A region whose windows
   would put its members in more than two regions on average gains nothing by splitting: it
   is dealt into blocks of about ``SMALL`` members, and each task joins two blocks exactly.

The links are reduced to components with the smallest doc_id as their name. They connect what
similarity connects, but are not all links: ``similarity_components`` stops there, for those
that only need components. ``similarity_links`` adds step 5:

5. A link never leaves its component, so every pair of classes of one component is verified,
   each once, on the whole sets, and the links of each class are counted. A component of two
   has its one link. A larger one is dealt into blocks of about ``SMALL`` members or
   ``BLOCK_SHINGLES`` shingles, and a task joins two of them; only counts leave it. That work
   grows with the square of a component's size.

``n_links`` is the number of other distinct sets that are linked with a document's own set, so
copies of one set have the same number and do not count each other.

Defined results: NULL and blank texts have no shingle and are linked with nothing; texts of
one to four words have one shingle, the whole sequence; rows with a NULL doc_id are linked
with nothing, have no links and a NULL component; rows that share a doc_id share a component; an
empty table gives an empty result. Shingles are compared by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.blocks import BLOCK, BLOCKS, blocks, runs
from wardledger.llm.components import components
from wardledger.llm.shared import drop_tables, mix, pack, shuffle_partitions, table, unpack, write_table

SHINGLE = 5
PERCENT = 80
RADIUS = 1 - PERCENT / 100
SMALL = 512
PART = 4096
PIVOTS = 128
BINS = 256
BLOCK_SHINGLES = 1 << 20
#: Tokens or shingles of a block that are worked on at once, about.
PORTION = 1 << 18
#: Upper bits of a fingerprint that deal a bucket's shingles into passes.
PASS_BITS = 3
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text, shingle), sorted; of words with ``hashes``.

    ``lengths``: words of each text.
    """
    text = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    keys = np.zeros(max(0, len(hashes) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        keys = keys * FACTOR + hashes[k : k + len(keys)]
    inside = np.arange(len(keys)) + SHINGLE <= ends[text[: len(keys)]]
    keys, owner = mix(keys[inside]), text[: len(keys)][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for k in range(SHINGLE - 1):
        more = lengths[short] > k
        at = (ends - lengths)[short] + k
        whole[more] = whole[more] * FACTOR + hashes[at[more]] + np.uint64(k + 1)
    keys, owner = np.concatenate([keys, mix(whole)]), np.concatenate([owner, short])
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    first = runs(owner, keys) if len(keys) else np.zeros(0, np.int64)
    return owner[first], keys[first]


def _portions(sizes: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of successive entries of at most ``PORTION`` together, or of a single one."""
    ends, at, found = np.cumsum(sizes), 0, []
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        found.append((at, to))
        at = to
    return found


def _block_shingles(row) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles each document of a block has, and all of them in the order of the documents.

    A document's last token is its end. Only the result is as long as the block.
    """
    lengths = unpack(row["lengths"]).astype(np.int64)
    tokens, hashes = unpack(row["tokens"]), unpack(row["hashes"])
    of_number = np.empty_like(hashes)
    of_number[unpack(row["numbers"])] = hashes
    ends = np.cumsum(lengths)
    n, keys, size = np.zeros(len(lengths), np.int64), np.empty(len(tokens), np.uint64), 0
    for i, j in _portions(lengths):
        first = ends[i] - lengths[i]
        own = np.delete(tokens[first : ends[j - 1]], ends[i:j] - 1 - first)
        owner, found = shingles(of_number[own], lengths[i:j] - 1)
        n[i:j] = np.bincount(owner, minlength=j - i)
        keys[size : size + len(found)] = found
        size += len(found)
    return n, keys[:size]


def _parts(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of ascending shingles; a bucket is a range of them."""
    lows = np.array([-(-(b << 32) // buckets) << 32 for b in range(buckets)], np.uint64)
    at = [*np.searchsorted(keys, lows).tolist(), len(keys)]
    return [(b, i, j) for b, (i, j) in enumerate(zip(at, at[1:])) if i < j]


def _requests(buckets):
    """Distinct shingles of each block with their counts, a row for each bucket."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                _, keys = _block_shingles(row)
                keys.sort()
                parts, prints, counts = _parts(keys, buckets), [], []
                for _, i, j in parts:
                    first = runs(keys[i:j])
                    # A bucket fixes the upper bits, so the lower ones tell its shingles apart.
                    prints.append(keys[i:j][first].astype("<u4").tobytes())
                    counts.append(pack(np.diff(first, append=j - i)))
                del keys
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
                    "block": pa.array([row["block"]] * len(parts), pa.int64()),
                    "keys": pa.array(prints, pa.binary()),
                    "counts": pa.array(counts, pa.binary()),
                })

    return run


def _counted(group: pa.Table) -> pa.Table:
    """Counts of all blocks together, for the shingles that each block asked for."""
    rows = group.select(["block", "bucket", "counts"]).to_pylist()
    keys = [np.frombuffer(k.as_buffer(), "<u4") for k in group.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    keys, counts = np.concatenate(keys), np.concatenate([unpack(r["counts"]) for r in rows])
    total = np.empty(len(keys), np.int64)
    # Equal shingles agree in their upper bits, so each value of those is a pass of its own.
    upper = (keys >> np.uint32(32 - PASS_BITS)).astype(np.uint8)
    for part in range(1 << PASS_BITS):
        own = np.flatnonzero(upper == part)
        if len(own):
            _, inverse = np.unique(keys[own], return_inverse=True)
            total[own] = np.bincount(inverse, counts[own])[inverse]
    return pa.table({
        "block": [r["block"] for r in rows],
        "bucket": [r["bucket"] for r in rows],
        "counts": [pack(total[i:j]) for i, j in zip([0, *ends[:-1]], ends)],
    })


SETS = "doc_id long, n_shingles long, weight double, digest binary, prefix array<long>, sketch binary, members binary"


def _sets(buckets):
    """Set size of every document; of those that may have partners, also what the join needs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n, keys = _block_shingles(row)
        found = np.sort(keys)
        found = found[runs(found)] if len(found) else found
        answers = {r["bucket"]: r["counts"] for r in right.select(["bucket", "counts"]).to_pylist()}
        counts = np.concatenate([np.zeros(0, np.uint8), *(unpack(answers[b]) for b, _, _ in _parts(found, buckets))])
        starts = np.cumsum(n) - n
        weight = np.zeros(len(n))
        out = {k: [None] * len(n) for k in ("digest", "prefix", "sketch", "members")}
        for at, to in _portions(n):
            sizes, base = n[at:to], starts[at]
            some = keys[base : base + sizes.sum()]
            count = counts[np.searchsorted(found, some)].astype(np.int64)
            owner = np.repeat(np.arange(to - at), sizes)
            shared = np.bincount(owner, count > 1, minlength=to - at).astype(np.int64)
            weight[at:to] = np.bincount(owner, np.log2(count), minlength=to - at) / np.maximum(sizes, 1)
            for i in at + np.flatnonzero((sizes > 0) & (100 * shared >= PERCENT * sizes)):
                if row["ids"][i] is None:
                    continue
                i_start = starts[i] - base
                own, often = some[i_start : i_start + n[i]], count[i_start : i_start + n[i]]
                first = int(n[i]) - -(-PERCENT * int(n[i]) // 100) + 1
                rare = np.lexsort((own, often))[:first]
                out["digest"][i] = xxhash.xxh3_128_digest(own.tobytes())
                out["prefix"][i] = own[rare[often[rare] > 1]].view(np.int64).tolist()
                out["members"][i] = own[often > 1].tobytes()
                out["sketch"][i] = sketch(own[often > 1])
        return pa.table({
            "doc_id": pa.array(row["ids"], pa.int64()),
            "n_shingles": pa.array(n, pa.int64()),
            "weight": pa.array(weight, pa.float64()),
            "digest": pa.array(out["digest"], pa.binary()),
            "prefix": pa.array(out["prefix"], pa.list_(pa.int64())),
            "sketch": pa.array(out["sketch"], pa.binary()),
            "members": pa.array(out["members"], pa.binary()),
        })

    return run


def shingle_sets(docs: DataFrame) -> tuple[DataFrame, str]:
    """Step 1 and 2 as a written table, and its path; see ``SETS``."""
    spark = docs.sparkSession
    packed, packed_path = write_table(
        docs.select("doc_id", F.lit(False).alias("held"), "text").mapInArrow(blocks, BLOCKS), "shingle-blocks"
    )
    tokens = packed.agg(F.coalesce(F.sum("trained"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), -(-tokens // BLOCK))
    counts = (
        packed.mapInArrow(_requests(buckets), "bucket long, block long, keys binary, counts binary")
        .groupBy("bucket").applyInArrow(_counted, "block long, bucket long, counts binary")
    )
    sets, path = write_table(
        packed.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_sets(buckets), SETS), "shingle-sets"
    )
    drop_tables(spark, packed_path)
    return sets, path


def _overlap(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0


def sketch(members: np.ndarray) -> bytes:
    """How many members fall in each of ``BINS`` bins by hash.

    The weighted Jaccard distance of two sketches is a metric and at most the Jaccard
    distance of the sets: the smaller counts of each bin add up to the overlap or more.
    """
    return np.bincount((members >> np.uint64(40)) % np.uint64(BINS), minlength=BINS).astype("<u4").tobytes()


def _overlaps(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Overlap that the sketches allow at most, of one set with each of many."""
    return np.minimum(one, many).sum(axis=1, dtype=np.int64)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, BINS)


def _compare(batches):
    """Rows (x, n, sketch, p, m, p_sketch) -> the pairs that their sketches allow to be linked."""
    for batch in batches:
        most = np.minimum(_matrix(batch.column(2)), _matrix(batch.column(5))).sum(axis=1, dtype=np.int64)
        n, m = batch.column(1).to_numpy(), batch.column(4).to_numpy()
        near = pa.array(100 * most >= PERCENT * (n + m - most))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(3).filter(near)], ["x", "p"])


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    own = classes.select("x", "n", "sketch")
    other = own.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("sketch").alias("p_sketch"))
    rows = pairs.join(own, "x").join(other, "p").select("x", "n", "sketch", "p", "m", "p_sketch")
    return rows.mapInArrow(_compare, "x long, p long")


def _verify(batches):
    """Rows (x, n, members, p, m, p_members) -> the pairs that are linked."""
    for batch in batches:
        x, n, a, p, m, b = (batch.column(i).to_pylist() for i in range(6))
        kept = []
        for i in range(len(x)):
            both = _overlap(a[i], b[i])
            if 100 * both >= PERCENT * (n[i] + m[i] - both):
                kept.append(i)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for i in kept], pa.int64()), pa.array([p[i] for i in kept], pa.int64())], ["a", "b"]
        )


def _linked(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) among the distinct pairs (x, p), by their whole sets."""
    own = classes.select("x", "n", "members")
    other = own.select(F.col("x").alias("p"), F.col("n").alias("m"), F.col("members").alias("p_members"))
    rows = pairs.select("x", "p").join(own, "x").join(other, "p").select("x", "n", "members", "p", "m", "p_members")
    return rows.mapInArrow(_verify, "a long, b long")


def _inside(group: pa.Table) -> pa.Table:
    """Pairs (x, p) of a block pair (i, j) whose sketches allow a link that is not known yet."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    x, n, g, slot = (group.column(c).to_numpy() for c in ("x", "n", "g", "slot"))
    sketches = _matrix(group.column("sketch"))
    second = np.flatnonzero(slot == j)
    found = []
    for a in np.flatnonzero(slot == i):
        other = second[(g[second] != g[a]) & (100 * np.minimum(n[second], n[a]) >= PERCENT * np.maximum(n[second], n[a]))]
        if i == j:
            other = other[x[other] < x[a]]
        most = _overlaps(sketches[a], sketches[other])
        found += [(x[a], x[b]) for b in other[100 * most >= PERCENT * (n[a] + n[other] - most)]]
    return pa.table({"x": pa.array([a for a, _ in found], pa.int64()), "p": pa.array([b for _, b in found], pa.int64())})


def _block_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs to verify within each region of ``members`` (region, x, g, size).

    A region is dealt into blocks of about ``SMALL`` members, and a task compares two of them.
    Only pairs that may be links between different groups leave the task.
    """
    blocks = F.ceil(F.col("size") / SMALL)
    dealt = members.withColumn("slot", F.expr("pmod(xxhash64(x), ceil(size / %d))" % SMALL))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("region", "x", "g", "slot", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))
    return (
        dealt.join(classes.select("x", "n", "sketch"), "x").groupBy("region", "i", "j")
        .applyInArrow(_inside, "x long, p long")
    )


WINDOWS = "region long, x long, weight double, g long, size long, cells array<long>, near array<long>"


def _windows(left: pa.Table, right: pa.Table) -> pa.Table:
    """Of each member of a region: the cells of pivots that it falls in, and pivots that it may be linked to."""
    pivots, sketches = right.column("p").to_numpy(), _matrix(right.column("p_sketch"))
    m, groups, totals = right.column("m").to_numpy(), right.column("p_g").to_numpy(), sketches.sum(axis=1, dtype=np.int64)
    own = _matrix(left.column("sketch"))
    cells, near = [], []
    for x, n, g, mine in zip(*(left.column(c).to_pylist() for c in ("x", "n", "g")), own):
        most = _overlaps(mine, sketches)
        gap = 1 - most / np.maximum(int(mine.sum(dtype=np.int64)) + totals - most, 1)
        # A small allowance keeps rounding from losing a boundary member.
        inside = gap <= gap.min() + 2 * RADIUS + 1e-9
        cells.append([] if x in pivots else pivots[inside].tolist())
        near.append(pivots[(100 * most >= PERCENT * (n + m - most)) & (groups != g)].tolist())
    lists = {"cells": pa.array(cells, pa.list_(pa.int64())), "near": pa.array(near, pa.list_(pa.int64()))}
    return pa.table({c: left.column(c) for c in ("region", "x", "weight", "g", "size")} | lists)


def _voronoi(large: DataFrame, classes: DataFrame, level: int) -> DataFrame:
    """``WINDOWS`` of the members of large regions; a pivot itself falls in no cell.

    Parts of about ``PART`` members of a region meet its pivots, whatever its size.
    """
    # Pivots of different groups, as members of one group are no news to each other.
    slot = F.pmod(F.xxhash64("g", F.lit(level)), F.lit(PIVOTS))
    known = classes.select("x", "n", "sketch")
    pivots = (
        large.groupBy("region", "size", slot.alias("slot")).agg(F.max(F.struct("weight", (-F.col("x")).alias("x"), "g")).alias("top"))
        .select("region", "size", (-F.col("top.x")).alias("x"), F.col("top.g").alias("p_g")).join(known, "x")
        .select(F.col("region").alias("of"), F.col("x").alias("p"), "p_g", F.col("n").alias("m"), F.col("sketch").alias("p_sketch"),
                F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / PART) - 1)).alias("of_part"))
    )
    parts = large.join(known, "x").withColumn("part", F.expr(f"pmod(xxhash64(x), ceil(size / {PART}))"))
    return parts.groupBy("region", "part").cogroup(pivots.groupBy("of", "of_part")).applyInArrow(_windows, WINDOWS)


#: The pivot of a region: the member whose shingles are the most common ones. Of copies with
#: small changes it is the one nearest to all others.
CENTRE = "max_by(x, struct(weight, -x))"


def _one_of_equal(members: DataFrame) -> DataFrame:
    """(region, size, p) of one region for each set of members (region, x, weight), with its pivot."""
    mark = F.xxhash64("x")
    regions = members.groupBy("region").agg(
        F.count("*").alias("size"), F.expr(CENTRE).alias("p"), F.bit_xor(mark).alias("m1"),
        F.sum(F.shiftright(F.xxhash64("x", F.lit(1)), 8)).alias("m2"),
    ).where("size > 1")
    return regions.groupBy("size", "p", "m1", "m2").agg(F.min("region").alias("region")).select("region", "size", "p")


def _open(members: DataFrame, links: DataFrame) -> DataFrame:
    """(region, x, weight, g, size) of the regions whose members ``links`` do not connect yet.

    Members with the same g are connected; of regions with the same members one is left.
    """
    named = components(links).select(F.col("vertex").alias("x"), F.col("component").alias("label"))
    grouped = members.join(named, "x", "left").select("region", "x", "weight", F.coalesce("label", "x").alias("g"))
    several = grouped.groupBy("region").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high")
    grouped = grouped.join(several.select("region"), "region")
    return grouped.join(_one_of_equal(grouped).drop("p"), "region")


def region_links(classes: DataFrame) -> DataFrame:
    """Steps 3 and 4: links (a, b) that connect what similarity connects.

    ``classes``: (x, n, weight, prefix, sketch, members), one row per distinct set.
    """
    spark = classes.sparkSession
    postings = classes.select("x", "weight", F.explode("prefix").alias("region"))
    started, started_path = write_table(
        postings.join(_one_of_equal(postings), "region").where("x <> p").select("x", "weight", "p").distinct(), "regions"
    )
    links, links_path = write_table(_linked(_near(started.select("x", "p"), classes), classes), "jaccard-links")
    # From here on, the region of a pivot is all that shares a start region with it.
    left, left_path = started.select(F.col("p").alias("region"), "x", "weight"), started_path
    level = 0
    while True:
        members, members_path = write_table(_open(left, links), "open-regions")
        drop_tables(spark, left_path)
        pairs = _block_pairs(members.where(F.col("size") <= SMALL), classes)
        large = members.where(F.col("size") > SMALL)
        done = large.isEmpty()
        if not done:
            level += 1
            windows, left_path = write_table(_voronoi(large, classes, level), "voronoi")
            # Regions whose windows replicate most members anyway are joined as they are.
            dense = windows.groupBy("region").agg(
                F.sum(F.size("cells")).alias("in_cells"), F.first("size").alias("members")
            ).where("in_cells > 2 * members").select("region")
            whole = windows.where(F.size("cells") > 0).join(dense, "region", "left_semi")
            pairs = pairs.unionByName(_block_pairs(whole, classes)).unionByName(windows.select("x", F.explode("near").alias("p")))
            split = windows.join(dense, "region", "left_anti").select("region", "x", "weight", F.explode("cells").alias("p"))
            left = split.select(F.xxhash64("region", "p").alias("region"), "x", "weight")
            done = left.isEmpty()
        once = pairs.select(F.greatest("x", "p").alias("x"), F.least("x", "p").alias("p")).distinct()
        more, more_path = write_table(links.unionByName(_linked(once, classes)), "jaccard-links")
        drop_tables(spark, links_path, members_path)
        links, links_path = more, more_path
        if done:
            return links


def _expanded(rows: np.ndarray, many: np.ndarray, starts: np.ndarray, others: np.ndarray, width: int, most: int):
    """Cells (row, other) of every entry with each of its ``many`` others, in portions of about ``most``."""
    ends = np.cumsum(many)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        times = many[at:to]
        inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        yield np.repeat(rows[at:to] * width, times) + others[np.repeat(starts[at:to], times) + inside]
        at = to


def overlaps(a: list[bytes], b: list[bytes], columns: int = 2048, most: int = 1 << 21) -> np.ndarray:
    """Size of the overlap of each set of ``a`` with each of ``b``.

    Shingles that many sets of both have are multiplied as matrices, the others pair by pair.
    """
    sets = [np.frombuffer(x, np.uint64) for x in (*a, *b)]
    both = np.zeros(len(a) * len(b), np.int64)
    found, key = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    left = owner < len(a)
    in_a, in_b = np.bincount(key[left], minlength=len(found)), np.bincount(key[~left], minlength=len(found))
    common = np.flatnonzero(64 * in_a * in_b > len(both))
    of_common = np.full(len(found), -1)
    of_common[common] = np.arange(len(common))
    for low in range(0, len(common), columns):
        at = of_common[key] - low
        inside = (at >= 0) & (at < columns)
        dense = np.zeros((len(sets), min(columns, len(common) - low)), np.float32)
        dense[owner[inside], at[inside]] = 1
        both += (dense[: len(a)] @ dense[len(a) :].T).astype(np.int64).ravel()
    order = np.argsort(key[~left], kind="stable")
    others, starts = owner[~left][order] - len(a), np.cumsum(in_b) - in_b
    rare = left & (of_common[key] < 0) & (in_b[key] > 0)
    for cells in _expanded(owner[rare], in_b[key[rare]], starts[key[rare]], others, len(b), most):
        both += np.bincount(cells, minlength=len(both))
    return both.reshape(len(a), len(b))


def _links_between(x, n, members, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which of the sets at ``first`` are linked with which at ``second``; no set with itself."""
    both = overlaps([members[k] for k in first], [members[k] for k in second])
    either = n[first][:, None] + n[second] - both
    return (100 * both >= PERCENT * either) & (x[first][:, None] != x[second])


def _count_links(group: pa.Table) -> pa.Table:
    """(x, n_links) within a block pair (i, j) of a component, or within each whole component of a task."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    x, n, component, slot = (group.column(c).to_numpy() for c in ("x", "n", "component", "slot"))
    members = group.column("members").to_pylist()
    links = np.zeros(len(x), np.int64)
    if i == j:
        order = np.argsort(component, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            links[own] = _links_between(x, n, members, own, own).sum(axis=1)
    else:
        first, second = np.flatnonzero(slot == i), np.flatnonzero(slot == j)
        if len(first) and len(second):
            linked = _links_between(x, n, members, first, second)
            links[first], links[second] = linked.sum(axis=1), linked.sum(axis=0)
    return pa.table({"x": x, "n_links": links})


def link_counts(classes: DataFrame, named: DataFrame) -> DataFrame:
    """Step 5: (x, n_links) of the classes that have a link; ``named``: their (vertex, component)."""
    spark = classes.sparkSession
    within = named.select(F.col("vertex").alias("x"), "component").join(classes.select("x", "n"), "x")
    blocks = F.greatest(F.ceil(F.col("size") / SMALL), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    sizes = within.groupBy("component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"))
    sized, _ = write_table(
        within.join(sizes.select("component", "size", blocks), "component").select("x", "n", "component", "size", "blocks"),
        "sized-components",
    )
    several = sized.where("size > 2")
    whole = several.where("blocks = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = max(shuffle_partitions(spark), -(-whole // BLOCK_SHINGLES))
    # Components of one block share tasks, as most have only a few members.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component"))
    dealt = (
        several.withColumn("task", task).withColumn("slot", F.expr("pmod(xxhash64(x), blocks)"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("long") - 1)))
        .select("task", (F.col("blocks") == 1).alias("shared"), "component", "x", "slot",
                F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"))
    )
    counted = (
        dealt.join(classes.select("x", "n", "members"), "x").groupBy("task", "shared", "i", "j")
        .applyInArrow(_count_links, "x long, n_links long")
    )
    two = sized.where("size = 2").select("x", F.lit(1).cast("long").alias("n_links"))
    return two.unionByName(counted.groupBy("x").agg(F.sum("n_links").alias("n_links")))


def _joined(docs: DataFrame, counted: bool) -> DataFrame:
    """doc_id, n_shingles and component_id of every row, and n_links if ``counted``."""
    sets, _ = shingle_sets(docs)
    possible = sets.where("digest IS NOT NULL")
    class_of = possible.groupBy("digest").agg(F.min("doc_id").alias("x"))
    classes, _ = write_table(
        possible.join(class_of, (possible.digest == class_of.digest) & (possible.doc_id == class_of.x), "left_semi")
        .dropDuplicates(["digest"])
        .select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), "weight", "prefix", "sketch", "members"),
        "classes",
    )
    named = components(region_links(classes))
    found = class_of.join(named, class_of.x == named.vertex, "left").select("digest", "x", F.coalesce("component", "x").alias("component_id"))
    alone = sets.where("digest IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    if counted:
        found = found.join(link_counts(classes, named), "x", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
        alone = alone.withColumn("n_links", F.lit(0).cast("long"))
        columns.append("n_links")
    of_class, _ = write_table(found.drop("x"), "class-components")
    return alone.unionByName(possible.select("doc_id", "n_shingles", "digest").join(of_class, "digest").select(*columns))


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; looks only at the pairs that components need."""
    return _joined(docs, counted=False)


def similarity_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row; no link between different sets is left out."""
    return _joined(docs, counted=True)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose component has a smaller doc_id."""
    near = similarity_components(docs).where("component_id < doc_id").select(F.col("doc_id").alias("__near")).distinct()
    return docs.join(near, F.col("doc_id") == F.col("__near"), "left_anti")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_links(table(spark, sf_dir, "documents"))
