"""Exact sums of doubles: the same bits for any order and partitioning of the rows.

A floating sum depends on the order in which tasks finish. Here every amount is split by its
exponent into six integer *limbs* of 24 bits, which stand on a fixed grid from 2**-80 upwards.
Limbs are added as BIGINT, which loses nothing, and only the final sum is rounded, once, to the
nearest double (ties to even). The sums are plain aggregates, partial before their one shuffle,
and rows of sums (``partial``) can be added again by any coarser key (``combine``).

Amounts from 2**-28 (4e-9) to 2**78 (3e23) in any mixture, and zero, are summed exactly: all
their bits lie on the grid. What lies beyond, and NaN and infinities, is added as SUM adds it
and then joins the exact part. Sums of limbs stay below 2**63 for 5 * 10**11 rows of a group
and for sums up to 10**31.

Products enter as two doubles, the rounded product and its error, so that squares and weighted
sums are exact too (squares of amounts below 2**39); the spread is formed from sums kept to
twice the precision of a double.

The final rounding is a chain of projections. To join a summary on its sums, write it first: the
optimiser would carry what it infers of every step through the join.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

LIMB, LIMBS = 24, 6
SMALLEST, LARGEST = -28, 78
#: Unit of the lowest limb, as a power of two.
UNIT = -80
_MASK = f"{(1 << LIMB) - 1}L"


@dataclass(frozen=True)
class Measure:
    """What a group is asked for; ``value`` names a column, or is the condition of ``count_if``."""

    kind: str
    value: str | None = None
    weight: str | None = None


def total(name: str, weight: str | None = None) -> Measure:
    """Sum of a column as DOUBLE, each row times an integer ``weight`` if given; NULL for no value."""
    return Measure("total", name, weight)


def mean(name: str, weight: str | None = None) -> Measure:
    return Measure("mean", name, weight)


def spread(name: str) -> Measure:
    """Sample standard deviation; NULL for fewer than two values."""
    return Measure("spread", name)


def average(name: str) -> Measure:
    """Mean of an integer column."""
    return Measure("average", name)


def count(name: str | None = None) -> Measure:
    return Measure("count", name)


def total_count(name: str) -> Measure:
    """Sum of an integer column as BIGINT."""
    return Measure("total_count", name)


def count_if(condition: str) -> Measure:
    """Rows for which an SQL condition holds."""
    return Measure("count_if", condition)


def smallest(name: str) -> Measure:
    return Measure("smallest", name)


def largest(name: str) -> Measure:
    return Measure("largest", name)


# SQL texts. One text instead of dozens of column calls: building those took longer than
# running them on small tables.

Steps = list[dict[str, str]]


def split_steps(names: list[str]) -> Steps:
    """y, h, m and l of each double column: the value if it is on the grid, and its limbs in three numbers of 48 bits."""
    near = f"{{x}} = 0D OR abs({{x}}) >= {2.0**SMALLEST!r}D AND abs({{x}}) < {2.0**LARGEST!r}D"
    middle, low = f"({{n}}_y - {{n}}_h * {2.0**16!r}D)", f"- {{n}}_m * {2.0**-32!r}D"
    return [
        {f"{n}_y": f"IF({near.format(x=n)}, {n}, 0D)" for n in names},
        {f"{n}_h": f"CAST({n}_y * {2.0**-16!r}D AS BIGINT)" for n in names},
        {f"{n}_m": f"CAST({middle.format(n=n)} * {2.0**32!r}D AS BIGINT)" for n in names},
        {f"{n}_l": f"CAST(({middle.format(n=n)} {low.format(n=n)}) * {2.0**80!r}D AS BIGINT)" for n in names},
    ]


def _limbs(n: str) -> list[str]:
    return [part for x in "lmh" for part in (f"{n}_{x} & {_MASK}", f"shiftright({n}_{x}, {LIMB})")]


def limb_sums_sql(n: str) -> list[str]:
    """Aggregates of one split column: its limbs, what is beyond the grid, and the number of values."""
    return [
        *[f"sum({limb}) AS {n}_{k}" for k, limb in enumerate(_limbs(n))],
        f"sum(IF({n} = {n}_y, NULL, {n})) AS {n}_f", f"count({n}) AS {n}_n",
    ]


def merged_sql(n: str) -> list[str]:
    return [f"sum({n}_{k}) AS {n}_{k}" for k in (*range(LIMBS), "f", "n")]


def _texts(step: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in step.items()]


def _add_sql(source: str, steps: Steps) -> str:
    for step in filter(None, steps):
        source = f"SELECT *, {', '.join(_texts(step))} FROM ({source})"
    return source


def _add(df: DataFrame, steps: Steps) -> DataFrame:
    """All steps as one text: each DataFrame call would cost an analysis."""
    if not any(steps):
        return df
    return df.sparkSession.sql(_add_sql("SELECT * FROM {rows}", steps), rows=df)


def _side_by_side(each: list[Steps]) -> Steps:
    return [{k: v for steps in each if i < len(steps) for k, v in steps[i].items()} for i in range(max(map(len, each), default=0))]


def nearest_steps(n: str, limbs: list[str]) -> Steps:
    """Columns that end in ``{n}_v``, the double nearest to a sum of limbs.

    Carries leave digits of 24 bits under a signed head; they become three doubles that do not
    overlap. Their sum is rounded once: two error-free additions leave a head and a rest, and if
    head and rest meet half-way between two doubles, what the rest itself lost decides.
    """
    c = [f"{n}_c{k}" for k in range(LIMBS)]
    two = lambda k: f"(({c[k + 1]} & {_MASK}) * {1 << LIMB} + ({c[k]} & {_MASK}))"
    a, b, z, u, t, ul, tl, v, e, r, d = (f"{n}_{x}" for x in ("ha", "hb", "hc", "hu", "ht", "hul", "htl", "hv", "he", "hr", "hd"))
    # What x + y lost against s, exact for any two doubles.
    lost = lambda x, y, s: f"(({x} - ({s} - ({s} - {x}))) + ({y} - ({s} - {x})))"
    return [
        {c[0]: limbs[0]},
        *[{c[k]: f"{limbs[k]} + shiftright({c[k - 1]}, {LIMB})"} for k in range(1, LIMBS)],
        {
            # The head is exact below 2**69; a larger sum is rounded here, by itself.
            a: f"CAST({c[5]} AS DOUBLE) * {2.0**40!r}D + CAST({c[4]} & {_MASK} AS DOUBLE) * {2.0**16!r}D",
            b: f"CAST({two(2)} AS DOUBLE) * {2.0**-32!r}D", z: f"CAST({two(0)} AS DOUBLE) * {2.0**UNIT!r}D",
        },
        {u: f"{b} + {z}"},
        {t: f"{a} + {u}", ul: f"{z} - ({u} - {b})"},
        {tl: lost(a, u, t)},
        {v: f"{tl} + {ul}"},
        {e: lost(tl, ul, v), r: f"{t} + {v}"},
        {d: f"{v} - ({r} - {t})"},
        {f"{n}_v": f"IF({e} <> 0D AND signum({e}) = signum({d}) AND ({r} + 2D * {d}) - {r} = 2D * {d}, {r} + 2D * {d}, {r})"},
    ]


def sum_steps(n: str, parts: list[str]) -> Steps:
    """Columns that end in ``{n}_v``, the exact part of the sum of one or more summed columns."""
    return nearest_steps(n, [" + ".join(f"coalesce({x}_{k}, 0L)" for x in parts) for k in range(LIMBS)])


def left_steps(n: str) -> Steps:
    """A column ``{n}o_v``: what the rounded sum ``{n}_v`` leaves of the exact one."""
    head = f"CAST({n}_c5 AS DOUBLE)"
    below = f"CAST({n}_c5 - CAST({head} AS BIGINT) AS DOUBLE) * {2.0**40!r}D + CAST({n}_c4 & {_MASK} AS DOUBLE) * {2.0**16!r}D"
    lost = f"({head} * {2.0**40!r}D - {n}_ha) + ({below})"  # by the head of a sum beyond 2**69
    return [{f"{n}o_v": f"(({n}_ht - {n}_v) + {n}_htl) + {n}_hul + ({lost})"}]


def _sum_sql(n: str, parts: list[str]) -> str:
    """The sum as SUM would give it: NULL for no value."""
    beyond = " + ".join(f"coalesce({x}_f, 0D)" for x in parts)
    return f"IF({parts[0]}_n = 0, NULL, {n}_v + ({beyond}))"


def product_error_sql(a: str, b: str) -> str:
    """What rounding took off a * b, as a double (Dekker's splitting)."""
    half = "134217729D"
    top = lambda x: f"({x} * {half} - ({x} * {half} - {x}))"
    ah, bh = top(a), top(b)
    al, bl = f"({a} - {ah})", f"({b} - {bh})"
    return f"((({ah} * {bh} - {a} * {b}) + {ah} * {bl} + {al} * {bh}) + {al} * {bl})"


def _spread_sql(n: str) -> str:
    """Standard deviation from the sums of values and squares, each a double and what it left.

    n * squares - sum * sum, each product with its error.
    """
    rows, a, o, c, r = f"CAST({n}_n AS DOUBLE)", f"{n}_v", f"{n}o_v", f"({n}q_v + coalesce({n}p_f, 0D) + coalesce({n}e_f, 0D))", f"{n}qo_v"
    errors = f"({product_error_sql(rows, c)} - {product_error_sql(a, a)}) + ({rows} * {r} - 2D * {a} * {o})"
    return (
        f"CASE WHEN {n}_n < 2 THEN NULL WHEN isnan({n}_f) OR abs({n}_f) = double('Infinity') THEN double('NaN') "
        f"ELSE sqrt(greatest((({rows} * {c} - {a} * {a}) + ({errors})) / ({rows} * ({rows} - 1D)), 0D)) END"
    )


# Groups of a DataFrame

_FLOAT = (T.DoubleType, T.FloatType)
SUMMED = ("total", "mean", "spread")


def _sources(df: DataFrame, measures: dict[str, Measure]) -> dict[tuple, str]:
    """Names of the summed columns by (column, weight, what): the value, a product or its error."""
    found: dict[tuple, str] = {}
    for m in measures.values():
        if m.kind in SUMMED and isinstance(df.schema[m.value].dataType, _FLOAT):
            base = found.setdefault((m.value, m.weight, ""), f"__s{len(found)}")
            if m.kind == "spread" or m.weight:
                found[m.value, m.weight, "p"] = f"{base}p"
                found[m.value, m.weight, "e"] = f"{base}e"
    return found


def _values(sources: dict[tuple, str]) -> list[str]:
    out = []
    for (column, weight, what), name in sources.items():
        x = f"CAST(`{column}` AS DOUBLE)"
        y = f"CAST(`{weight}` AS DOUBLE)" if weight else x
        product = f"{x} * {y}" if what == "p" else product_error_sql(x, y)
        out.append(f"{x} AS {name}" if not what else f"{product} AS {name}")
    return out


def _others(df: DataFrame, measures: dict[str, Measure], sources: dict[tuple, str]):
    """Further aggregates: (name, value of a row or None, first aggregate, merging aggregate)."""
    out = []
    for alias, m in measures.items():
        name = f"__{alias}"
        if m.kind == "count":
            out.append((name, F.lit(1) if m.value is None else F.col(m.value), F.count, F.sum))
        elif m.kind == "total_count":
            out.append((name, F.col(m.value), F.sum, F.sum))
        elif m.kind == "count_if":
            out.append((name, F.expr(m.value), F.count_if, F.sum))
        elif m.kind in ("smallest", "largest"):
            fold = F.min if m.kind == "smallest" else F.max
            out.append((name, F.col(m.value), fold, fold))
        elif m.kind == "average" or (m.value, m.weight, "") not in sources:
            value = F.col(m.value) if not m.weight else F.col(m.value) * F.col(m.weight)
            out += [(name, value, F.sum, F.sum), (f"{name}_n", F.col(m.weight or m.value) if not m.weight else F.when(F.col(m.value).isNotNull(), F.col(m.weight)), F.sum if m.weight else F.count, F.sum)]
        elif m.weight and m.kind == "mean":
            out.append((f"{name}_n", F.when(F.col(m.value).isNotNull(), F.col(m.weight)), F.sum, F.sum))
    return out


def partial(df: DataFrame, keys: dict[str, Column], measures: dict[str, Measure]) -> DataFrame:
    """Sums of limbs and further aggregates by ``keys``; ``combine`` adds them up by coarser keys."""
    sources = _sources(df, measures)
    others = _others(df, measures, sources)
    names = list(sources.values())
    rows = df.select(
        *[k.alias(name) for name, k in keys.items()], *map(F.expr, _values(sources)),
        *[value.alias(name) for name, value, _, _ in others],
    )
    rows = _add(rows, split_steps(names))
    return rows.groupBy(*keys).agg(
        *[F.expr(text) for n in names for text in limb_sums_sql(n)],
        *[first(name).alias(name) for name, _, first, _ in others]
    )


def combine(df: DataFrame, parts: DataFrame, keys: list[str], measures: dict[str, Measure]) -> DataFrame:
    """The measures of ``df`` by ``keys`` from its partial rows."""
    sources = _sources(df, measures)
    merged = parts.groupBy(*keys).agg(
        *[F.expr(text) for n in sources.values() for text in merged_sql(n)],
        *[merge(name).alias(name) for name, _, _, merge in _others(df, measures, sources)],
    )
    if not keys:
        counts = [f"{n}_n" for n in sources.values()] + [f"__{a}" for a, m in measures.items() if m.kind in ("count", "count_if")]
        merged = merged.fillna(0, counts)
    return _finished(merged, keys, measures, sources)


def _finished(merged: DataFrame, keys: list[str], measures: dict[str, Measure], sources: dict[tuple, str]) -> DataFrame:
    values, squares, weighted = [], [], []
    for m in measures.values():
        own = sources.get((m.value, m.weight, "")) if m.kind in SUMMED else None
        if own:
            (weighted if m.weight else values).append(own)
            if m.kind == "spread":
                squares.append(own)
    sums = [sum_steps(n, [n]) for n in dict.fromkeys(values)]
    sums += [sum_steps(f"{n}q", [f"{n}p", f"{n}e"]) for n in dict.fromkeys([*squares, *weighted])]
    left = [x for n in dict.fromkeys(squares) for x in (left_steps(n), left_steps(f"{n}q"))]
    merged = _add(merged, [*_side_by_side(sums), *_side_by_side(left)])
    return merged.select(*keys, *[_result(alias, m, sources).alias(alias) for alias, m in measures.items()])


def _result(alias: str, m: Measure, sources: dict[tuple, str]) -> Column:
    name = f"__{alias}"
    if m.kind in ("count", "count_if", "total_count", "smallest", "largest"):
        return F.col(name)
    own = sources.get((m.value, m.weight, ""))
    if m.kind == "average" or own is None:
        whole = F.col(name).cast("double")
        return whole if m.kind == "total" else F.try_divide(whole, F.col(f"{name}_n"))
    if m.kind == "spread":
        return F.expr(_spread_sql(own))
    if m.weight:
        whole = F.expr(f"IF({own}_n = 0, NULL, {own}q_v + coalesce({own}p_f, 0D) + coalesce({own}e_f, 0D))")
        return whole if m.kind == "total" else F.try_divide(whole, F.col(f"{name}_n"))
    whole = F.expr(_sum_sql(own, [own]))
    return whole if m.kind == "total" else F.try_divide(whole, F.col(f"{own}_n"))


def summarise(df: DataFrame, keys: dict[str, Column], measures: dict[str, Measure]) -> DataFrame:
    """Measures of each group of ``df``; one row for no keys."""
    return _finished(partial(df, keys, measures), list(keys), measures, _sources(df, measures))


def summary_ctes(view: str, keys: dict[str, str], columns: list[str], where: str) -> tuple[str, dict[str, tuple[str, str]]]:
    """SQL text of the same for double columns: a CTE ``merged``, and texts of sum and count by column."""
    names = {c: f"__s{i}" for i, c in enumerate(columns)}
    own = list(names.values())
    rows = f"SELECT {', '.join(f'{k} AS {n}' for n, k in keys.items())}, {', '.join(f'{c} AS {n}' for c, n in names.items())} FROM {view} WHERE {where}"
    grouped = f"SELECT {', '.join(keys)}, {', '.join(t for n in own for t in limb_sums_sql(n))} FROM ({_add_sql(rows, split_steps(own))}) GROUP BY {', '.join(keys)}"
    text = f"merged AS ({_add_sql(grouped, _side_by_side([sum_steps(n, [n]) for n in own]))})"
    return text, {c: (_sum_sql(n, [n]), f"{n}_n") for c, n in names.items()}
