"""Typed histograms, exact ranks and distinct counts against plain Python."""

import decimal
import math
import random

import pytest

from estatelens.operators import profiling as P
from estatelens.operators import typed_values as V

D = decimal.Decimal
WANTED = {"m": V.UPPER_MEDIAN, "a": 0.25, "z": 0.9}
SPEC = "k long, big long, wide decimal(38,10), small decimal(9,3), real double, single float, name string, flag boolean, m map<string,int>"


def table(n, seed=0):
    rnd = random.Random(seed)
    some = lambda f: None if rnd.random() < 0.1 else f()
    reals = [0.0, -0.0, math.inf, -math.inf, 1e-300, -1e300, 2.5]
    with decimal.localcontext(prec=50):
        return [(i, some(lambda: rnd.choice((1, -1)) * (2**53 + rnd.randrange(6))), some(lambda: rnd.choice((1, -1)) * (D(10**27) + D(rnd.randrange(9))) + D(rnd.randrange(100)) / 100), some(lambda: D(rnd.randrange(-1500, 1500)) / 1000),
                 some(lambda: rnd.choice([*reals, rnd.uniform(-3, 3)])), some(lambda: float(rnd.randrange(-4, 4))), some(lambda: rnd.choice("abé")), some(lambda: rnd.random() < 0.5), some(lambda: {"x": 1, "y": rnd.randrange(2)})) for i in range(n)]


def ranks(values):
    v = sorted(x for x in values if x is not None)
    return {q: v[len(v) // 2 if p == V.UPPER_MEDIAN else math.floor((len(v) - 1) * p)] for q, p in WANTED.items()}


@pytest.mark.parametrize("n,digits,closing", [(400, 4, 65_536), (400, 1, 1), (400, 3, 7), (2, 4, 1)])
def test_quantiles_are_exact(spark, n, digits, closing):
    rows = table(n, n)
    df = spark.createDataFrame(rows, SPEC).repartition(3)
    got = {r.column_name: r for r in V.exact_quantiles(df, ["k", "big", "wide", "small", "real", "single"], WANTED, digits, closing).collect()}
    for i, x in enumerate(["k", "big", "wide", "small", "real", "single"]):
        if all(r[i] is None for r in rows):
            assert x not in got
            continue
        for q, want in ranks([r[i] for r in rows]).items():
            have = got[x][q].replace("Infinity", "inf")
            assert (float(have) == want) if isinstance(want, float) else (D(have) == want), (x, q, have, want)


def test_counts_equal_sets(spark):
    rows = table(300) * 2
    df = spark.createDataFrame(rows, SPEC)
    cols = df.columns
    got = {r.column_name: (r.row_count, r.null_count, r.distinct_count) for r in P.profile_counts(df, cols).collect()}
    for i, x in enumerate(cols):
        v = [tuple(sorted(r[i].items())) if isinstance(r[i], dict) else r[i] for r in rows if r[i] is not None]
        assert got[x] == (len(rows), len(rows) - len(v), len(set(v))), x
    assert "Expand" not in P.profile_counts(df, cols)._jdf.queryExecution().executedPlan().toString()


def test_sample_profile_keeps_big_numbers_apart(spark):
    df = spark.createDataFrame([(2**53, D("1") / 3), (2**53 + 1, D(0)), (2**53 + 1, None), (-(2**62), D("-12345678901234567890.5"))], "v long, d decimal(38,12)")
    r = {x.column_name: x for x in P.sample_profile(df).collect()}
    assert (r["v"].distinct_sampled, r["v"].min_value_exact, r["v"].max_value_exact, r["v"].median_value_exact) == (3, str(-(2**62)), str(2**53 + 1), str(2**53 + 1))
    assert r["d"].min_value_exact == "-12345678901234567890.500000000000" and r["d"].nulls == 1


def test_tables_without_rows_or_values(spark):
    df = spark.createDataFrame([], SPEC)
    assert V.exact_quantiles(df, ["k", "wide"], WANTED).count() == 0
    assert {(r.row_count, r.null_count, r.distinct_count) for r in P.profile_counts(df, ["k", "name"]).collect()} == {(0, 0, 0)}
    assert {r.distinct_count for r in P.profile_table(df, ["k", "real"]).collect()} == {0}
    nulls = spark.createDataFrame([(None, None), (None, None)], "k long, wide decimal(38,2)")
    assert V.exact_quantiles(nulls, ["k", "wide"], WANTED).count() == 0
    r = P.sample_profile(nulls, ["k"]).first()
    assert (r.sampled, r.nulls, r.distinct_sampled, r.min_value, r.median_value_exact) == (2, 2, 0, None, None)
