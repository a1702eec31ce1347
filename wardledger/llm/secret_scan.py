"""Secrets in texts: fixed patterns, and random-looking strings by two character Markov models.

Patterns find three kinds (assign, access, hex). A fourth kind, markov, is a run of 12 or more
characters of ``RUN`` that looks random: one first-order character model is trained on random
strings, one on ordinary identifiers, and a run is reported where the log-likelihood ratio of
random over ordinary reaches ``THRESHOLD``.

Both models learn from labelled runs of *all* documents: runs inside the values that the fixed
patterns found are random, all other runs are ordinary. Each distinct run counts once, so a
string copied thousands of times weighs as much as any other. Ratios are whole thousandths of a
nat: sums are exact and do not depend on the order of tasks.

Everything is a DataFrame or SQL expression. Built-in functions return matches without their
places; these follow from the texts between matches (``split`` by the same pattern), whose
lengths are added up in chunks, so that a text of n matches costs about n steps and not n * n.
The texts themselves are never shuffled. The driver collects pair counts: at most
2 * 128 * 128 numbers, whatever the input.

Defined results: NULL text is empty; a text without findings has zero counts, the hash of the
empty string and empty ``spans``; rows are judged alone, so repeated rows get equal results; a
markov run may lie inside or beside a finding of the other kinds, and both are listed; without
any random sample (for example an empty table) nothing is reported as markov. Places count code
points. Extra columns of the input are ignored.
"""

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardledger.llm.shared import table


def any_case(word: str) -> str:
    """A pattern of ``word`` with its ASCII letters in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(any_case, ("password", "passwd", "secret", "token", "api_?key")))
VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?({VALUE})"""
#: The contract's AKIA[A-Z0-9]+ of 18 characters and [0-9a-f]+ of 16 or more: a match is a whole
#: run from its leftmost start, so asking for the length in the pattern finds the same ones.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
RUN = "[A-Za-z0-9+/_-]{12,}"
#: Kinds in the order in which findings of equal start are listed; pattern, and the shortest value.
KINDS = {"assign": (ASSIGN, 12), "access": (ACCESS, 18), "hex": (HEX, 16), "markov": (RUN, 12)}
BASE = ("assign", "access", "hex")
#: Thousandths of a nat by which a run must be likelier as a random string.
THRESHOLD = 8000
#: Added to each pair count; RUN has this many different characters.
SMOOTH, ALPHABET = 0.5, 66
CHUNK = 64

_NONE = "CAST(array() AS array<string>)"


def _found(kind: str, text: str, group: int) -> Column:
    """All matches of a kind; texts without any skip the search for the rest."""
    pattern = F.lit(KINDS[kind][0])
    return F.when(F.rlike(text, pattern), F.regexp_extract_all(text, pattern, F.lit(group))).otherwise(F.expr(_NONE))


def _at_least(n: int):
    return lambda value: F.char_length(value) >= n


def base_values(docs: DataFrame) -> DataFrame:
    """Column ``value``: the secrets proper of all findings of the fixed patterns."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    values = [
        F.filter(_found(kind, "text", 2 if kind == "assign" else 0), _at_least(KINDS[kind][1]))
        for kind in BASE
    ]
    return text.select(F.explode(F.concat(*values)).alias("value"))


def _runs(strings: Column) -> Column:
    return F.explode(F.regexp_extract_all(strings, F.lit(RUN), F.lit(0)))


def labelled_runs(docs: DataFrame) -> DataFrame:
    """Distinct runs (run, label): 1 inside a value that a fixed pattern found, otherwise 0."""
    random = base_values(docs).select(_runs(F.col("value")).alias("run"), F.lit(1).alias("label"))
    every = docs.select(_runs(F.coalesce("text", F.lit(""))).alias("run"), F.lit(0).alias("label"))
    return random.unionByName(every).groupBy("run").agg(F.max("label").alias("label"))


_CODES = "transform(split({x}, ''), c -> ascii(c))"
_PAIRS = "zip_with(slice({c}, 1, size({c}) - 1), slice({c}, 2, size({c}) - 1), (p, q) -> p * 128 + q)"


def train(runs: DataFrame) -> list[int] | None:
    """Log-likelihood ratio of each pair of characters, at first * 128 + second.

    None where one of the two classes has no sample.
    """
    codes = runs.select("label", F.expr(_CODES.format(x="run")).alias("c"))
    pairs = codes.select("label", F.explode(F.expr(_PAIRS.format(c="c"))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if {label for label, _ in counts} != {0, 1}:
        return None
    starts: dict[tuple[int, int], int] = {}
    for (label, pair), n in counts.items():
        key = label, pair >> 7
        starts[key] = starts.get(key, 0) + n

    def probability(label: int, pair: int) -> float:
        return (counts.get((label, pair), 0) + SMOOTH) / (starts.get((label, pair >> 7), 0) + SMOOTH * ALPHABET)

    return [round(1000 * math.log(probability(1, p) / probability(0, p))) for p in range(1 << 14)]


_PREFIX = (
    "transform({w}, (x, i) -> {b}[i div {n}] + aggregate(slice({w}, i - i % {n} + 1, i % {n} + 1), 0L, (s, y) -> s + y))"
)
_BASES = (
    "aggregate(sequence(0, greatest(size({w}) - 1, 0) div {n}), array(0L), (s, k) -> array_append(s, element_at(s, -1) "
    "+ aggregate(slice({w}, k * {n} + 1, {n}), 0L, (t, y) -> t + y)))"
)


def scan(docs: DataFrame, ratios: list[int] | None, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and one array of (start, end) for each kind, in order of place."""
    frame = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kinds = [k for k in KINDS if k != "markov" or ratios is not None]
    frame = frame.select(
        "*", *[_found(k, "text", 0).alias(f"{k}_m") for k in kinds], _found("assign", "text", 2).alias("assign_v")
    )
    keep = {k: f"char_length({'assign_v[i]' if k == 'assign' else 'x'}) >= {KINDS[k][1]}" for k in BASE}
    frame = frame.select("*", *[F.expr(f"transform({k}_m, (x, i) -> {keep[k]})").alias(f"{k}_ok") for k in BASE])
    if ratios is not None:
        # Folded into one constant array when the plan is optimised.
        ratio = F.from_json(F.lit(json.dumps(ratios)), "array<int>")
        codes = lambda run: F.transform(F.split(run, ""), lambda c: F.ascii(c))
        pairs = lambda c: F.zip_with(
            F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda p, q: F.get(ratio, p * 128 + q).cast("long")
        )
        frame = frame.withColumn("codes", F.transform("markov_m", codes)).withColumn(
            "markov_ok",
            F.transform("codes", lambda c: F.aggregate(pairs(c), F.lit(0).cast("long"), lambda s, x: s + x) >= threshold),
        )
    # Only texts with a finding are cut up for the places of their matches.
    frame = frame.select(
        "*",
        *[
            F.when(F.exists(f"{k}_ok", lambda x: x), F.split("text", KINDS[k][0], -1)).otherwise(F.expr(_NONE)).alias(f"{k}_gaps")
            for k in kinds
        ],
    )
    frame = frame.select(
        "*",
        *[
            F.expr(
                f"IF(size({k}_gaps) = 0, CAST(array() AS array<bigint>), transform({k}_m, "
                f"(x, i) -> CAST(char_length(x) + char_length({k}_gaps[i]) AS BIGINT)))"
            ).alias(f"{k}_w")
            for k in kinds
        ],
    )
    frame = frame.select("*", *[F.expr(_BASES.format(w=f"{k}_w", n=CHUNK)).alias(f"{k}_b") for k in kinds])
    frame = frame.select("*", *[F.expr(_PREFIX.format(w=f"{k}_w", b=f"{k}_b", n=CHUNK)).alias(f"{k}_e") for k in kinds])
    spans = {
        k: F.expr(
            f"filter(transform({k}_e, (e, i) -> IF({k}_ok[i], named_struct('start', e - char_length({k}_m[i]), 'end', e), NULL)), "
            "x -> x IS NOT NULL)"
        )
        for k in kinds
    }
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return frame.select("doc_id", *[spans.get(k, none).alias(k) for k in KINDS])


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the given kinds, by start and then kind, comma-joined."""
    tagged = [
        F.expr(f"transform({kind}, s -> named_struct('start', s.start, 'kind', {i}, 'end', s.end))")
        for i, kind in enumerate(kinds)
    ]
    names = F.array(*map(F.lit, kinds))
    each = F.transform(
        F.array_sort(F.concat(*tagged)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    )
    return F.array_join(each, ",")


def report(found: DataFrame) -> DataFrame:
    """Counts, hash of the fixed findings and all spans of each row of ``scan``."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(BASE), 256).alias("base_sha256"),
        listed(tuple(KINDS)).alias("spans"),
    )


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return report(scan(docs, train(labelled_runs(docs))))


def _sql() -> str:
    """The same in DuckDB. Patterns as strings of RE2, places by the texts between matches."""
    text = "coalesce(text, '')"
    quoted = {k: "'" + p.replace("'", "''") + "'" for k, (p, _) in KINDS.items()}
    found = ", ".join(
        f"regexp_extract_all(t, {quoted[k]}) AS {k}_m, regexp_extract_all(t, {quoted[k]}{', 2' if k == 'assign' else ''}) "
        f"AS {k}_v, string_split_regex(t, {quoted[k]}) AS {k}_g"
        for k in KINDS
    )
    values = " UNION ALL ".join(
        f"SELECT unnest(list_filter({k}_v, lambda v: len(v) >= {KINDS[k][1]})) AS value FROM found" for k in BASE
    )
    ends = ", ".join(
        f"list_transform(range(1, len({k}_m) + 1), lambda i: list_sum(list_transform({k}_m[1:i], lambda x: len(x))) "
        f"+ list_sum(list_transform({k}_g[1:i], lambda x: len(x))))::BIGINT[] AS {k}_e"
        for k in KINDS
    )
    spans = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {i} AS place, unnest({k}_e) AS e, unnest({k}_m) AS m, unnest({k}_v) AS v FROM placed"
        for i, k in enumerate(KINDS)
    )
    long_enough = " OR ".join(f"(kind = '{k}' AND len(v) >= {KINDS[k][1]})" for k in BASE)
    pairs = "unnest(list_transform(range(1, len(run)), lambda i: ascii(run[i]) * 128 + ascii(run[i + 1])))"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {text} AS t FROM documents),
found AS (SELECT r, {found} FROM docs),
placed AS (SELECT *, {ends} FROM found),
vals AS ({values}),
runs AS (
  SELECT run, max(label) AS label FROM (
    SELECT unnest(regexp_extract_all(value, {quoted["markov"]})) AS run, 1 AS label FROM vals
    UNION ALL SELECT unnest(markov_m), 0 FROM found) AS samples
  GROUP BY run),
pairs AS (SELECT label, {pairs} AS pair FROM runs),
counts AS (SELECT label, pair, count(*) AS n FROM pairs GROUP BY label, pair),
starts AS (SELECT label, pair // 128 AS first, sum(n) AS n FROM counts GROUP BY label, pair // 128),
ratios AS (
  SELECT p.pair, CAST(round(1000 * ln(
      (coalesce(a.n, 0) + {SMOOTH}::DOUBLE) / (coalesce(c.n, 0) + {SMOOTH * ALPHABET}::DOUBLE)
      / ((coalesce(b.n, 0) + {SMOOTH}::DOUBLE) / (coalesce(d.n, 0) + {SMOOTH * ALPHABET}::DOUBLE)))) AS BIGINT) AS ratio
  FROM (SELECT DISTINCT pair FROM pairs) AS p
  LEFT JOIN counts AS a ON a.label = 1 AND a.pair = p.pair
  LEFT JOIN counts AS b ON b.label = 0 AND b.pair = p.pair
  LEFT JOIN starts AS c ON c.label = 1 AND c.first = p.pair // 128
  LEFT JOIN starts AS d ON d.label = 0 AND d.first = p.pair // 128),
random AS (
  SELECT run FROM (SELECT run, {pairs} AS pair FROM runs) AS each JOIN ratios USING (pair)
  WHERE (SELECT count(DISTINCT label) FROM runs) = 2 GROUP BY run HAVING sum(ratio) >= {THRESHOLD}),
spans AS ({spans}),
kept AS (
  SELECT r, kind, place, e - len(m) AS s, kind || ':' || (e - len(m)) || ':' || e AS span FROM spans
  WHERE {long_enough} OR (kind = 'markov' AND m IN (SELECT run FROM random))),
lists AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY s, place) FILTER (kind <> 'markov') AS base,
    string_agg(span, ',' ORDER BY s, place) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN lists USING (r)
"""


SQL = _sql()
