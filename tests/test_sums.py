import math
import random
import statistics
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from wardledger.functions import sums


def exact(values):
    """Sum rounded once; Fraction to float rounds to the nearest, ties to even."""
    return float(sum(map(Fraction, values), Fraction(0)))


def doubles(spark, values):
    return spark.createDataFrame([(v,) for v in values], "x double")


def total(df):
    return sums.summarise(df, {}, {"t": sums.total("x")}).first()[0]


@pytest.mark.parametrize(
    "values",
    [
        [0.1, 0.2, 0.3],
        [0.00004] * 3,
        [1e16, 1.0, 1.0],
        [1e16, 1.0, -1e16],
        [1e300, 1.0, -1e300],
        [5e-324] * 7,
        [5e-324, 1.0],
        [2.0**53, 1.0],
        [2.0**53, 1.0, 2.0**-28],
        [-(2.0**53), -1.0, -(2.0**-28)],
        [2.0**63, 2.0**10, 2.0**-28, 2.0**-28 * (1 + 2.0**-52)],
        [-(2.0**63), -(2.0**10), 2.0**-28],
        [2.0**40 + 2.0**-12, 2.0**-13, 2.0**-28, -(2.0**-27)],
        [2.0**52, 0.5],
        [1.7976931348623157e308, 1e291],
        [2.0**-8, 2.0**40, -(2.0**-8) * (1 - 2.0**-53), 2.0**40 * (1 - 2.0**-53)],
        [2.0**k * f for k in (-27, 0, 16, 40, 63) for f in (1, 1 - 2.0**-53, -1 - 2.0**-52)],
        [2.0**k * (1 - 2.0**-53) for k in (-20, -8, 16, 40)],
        [0.0, -0.0],
        [3.0, -3.0],
        [-123456.7891, 98765.4321, -0.0001],
        [1e11 + 0.01] * 7 + [-0.03],
    ],
)
def test_total_is_the_nearest_double(spark, values):
    assert total(doubles(spark, values)) == exact(values)


def test_random_sums_and_partitionings(spark):
    rng = random.Random(7)
    values = [(k % 9, rng.choice((-1, 1)) * rng.uniform(1e-4, 1) * 10.0 ** rng.choice((0, 3, 6, 12, 17, -3))) for k in range(4000)]
    df = spark.createDataFrame(values, "k long, x double")
    want = {k: exact([v for j, v in values if j == k]) for k in range(9)}
    for partitions in (1, 13):
        rows = sums.summarise(df.repartition(partitions), {"k": F.col("k")}, {"t": sums.total("x"), "m": sums.mean("x")}).collect()
        assert {r["k"]: r["t"] for r in rows} == want
        assert all(r["m"] == r["t"] / sum(j == r["k"] for j, _ in values) for r in rows)


def test_amounts_beyond_the_grid_join_the_exact_part(spark):
    for values in ([1e27, 3e27, 0.1, 0.2], [1e-12] * 9, [1e30, -1e30, 0.1, 0.2, 1e-20]):
        assert total(doubles(spark, values)) == pytest.approx(exact(values), rel=1e-15)


def test_overflow_and_specials_follow_sum(spark):
    assert total(doubles(spark, [1.7e308, 1.7e308])) == math.inf
    assert total(doubles(spark, [1.0, math.inf])) == math.inf
    assert math.isnan(total(doubles(spark, [math.inf, -math.inf, 1.0])))
    assert math.isnan(total(doubles(spark, [math.nan, 1.0])))


def test_nulls_and_nothing(spark):
    df = doubles(spark, [1.5, None, 2.0])
    asked = {"t": sums.total("x"), "m": sums.mean("x"), "s": sums.spread("x"), "n": sums.count(), "c": sums.count("x"), "i": sums.count_if("x > 1.6")}
    assert tuple(sums.summarise(df, {}, asked).first())[:2] == (3.5, 1.75)
    assert tuple(sums.summarise(df, {}, asked).first())[3:] == (3, 2, 1)
    assert tuple(sums.summarise(df.limit(0), {}, asked).first()) == (None, None, None, 0, 0, 0)
    assert sums.summarise(df.limit(0), {"k": F.col("x")}, asked).collect() == []
    only = sums.summarise(doubles(spark, [None, None]), {}, asked).first()
    assert tuple(only) == (None, None, None, 2, 0, 0)


def test_decimals_and_integers_are_summed_as_they_are(spark):
    df = spark.createDataFrame([(Decimal("1.10"), 2), (Decimal("2.20"), 3)], "d decimal(18,2), i int")
    got = sums.summarise(df, {}, {"a": sums.total("d"), "b": sums.total("i"), "c": sums.mean("i"), "d": sums.average("i")}).first()
    assert tuple(got) == (3.3, 5.0, 2.5, 2.5)


def test_weighted_sums_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(-1e9, 1e9), rng.randint(1, 10**6)) for _ in range(300)] + [(None, 5)]
    df = spark.createDataFrame(rows, "x double, n long")
    got = sums.summarise(df, {}, {"t": sums.total("x", "n"), "m": sums.mean("x", "n")}).first()
    want = float(sum(Fraction(x) * n for x, n in rows if x is not None))
    assert got["t"] == want and got["m"] == want / sum(n for x, n in rows if x is not None)


@pytest.mark.parametrize("offset", [0.0, 1e9, -3e11])
def test_spread_with_a_large_common_offset(spark, offset):
    rng = random.Random(5)
    values = [offset + rng.gauss(0, 1) for _ in range(3000)]
    got = {sums.summarise(doubles(spark, values).repartition(n), {}, {"s": sums.spread("x")}).first()[0] for n in (1, 20)}
    assert len(got) == 1
    # Sums of squares have 106 bits: an offset of 3 * 10**11 deviations takes about 76 of them.
    assert got.pop() == pytest.approx(statistics.stdev(map(Fraction, values)), rel=1e-8 if offset < 0 else 1e-12)
    assert sums.summarise(doubles(spark, [2.0]), {}, {"s": sums.spread("x")}).first()[0] is None
    assert sums.summarise(doubles(spark, [offset] * 3), {}, {"s": sums.spread("x")}).first()[0] == 0.0


def test_partial_rows_merge_by_a_coarser_key(spark):
    df = spark.createDataFrame([(i % 3, i % 5, 0.1 * i - 7) for i in range(200)], "a long, b long, x double")
    asked = {"t": sums.total("x"), "s": sums.spread("x"), "low": sums.smallest("x"), "high": sums.largest("x")}
    parts = sums.partial(df, {"a": F.col("a"), "b": F.col("b")}, asked)
    for keys in ([], ["a"]):
        whole = sums.summarise(df, {k: F.col(k) for k in keys}, asked)
        assert sorted(map(tuple, sums.combine(df, parts, keys, asked).collect())) == sorted(map(tuple, whole.collect()))


def test_sql_text_gives_the_same(spark):
    df = doubles(spark, [0.1 * i for i in range(100)] + [1e300])
    df.selectExpr("CAST(x AS INT) % 3 AS k", "x").createOrReplaceTempView("sums_view")
    ctes, texts = sums.summary_ctes("sums_view", {"key": "k"}, ["x"], "x < 1e20")
    rows = spark.sql(f"WITH {ctes} SELECT key, {texts['x'][0]} AS t, {texts['x'][1]} AS n FROM merged").collect()
    want = {}
    for i in range(100):
        want.setdefault(int(0.1 * i) % 3, []).append(0.1 * i)
    assert {r["key"]: (r["t"], r["n"]) for r in rows} == {k: (exact(v), len(v)) for k, v in want.items()}
