"""Operators on small fixtures: boundaries, ties, nulls, skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pointgate.functions.scalar import half_up
from pointgate.operators import matching, metrics, ranking, scoring, temporal, valuation
from pointgate.operators.joins import salted_join


def test_asof_excludes_the_boundary(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 6), (3, "b", 1), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, "y"), (None, 1, "z")], "k string, u int, v string")
    got = temporal.asof_latest(left, right, key=["k"], time="t", right_time="u", payload=["v"])
    assert {r["id"]: r["asof_v"] for r in got.collect()} == {1: "y", 2: "x", 3: None, 4: None}


def test_gate_and_prior_period(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("a", 4, 40)], "k string, p int, v int")
    assert temporal.gate(df, "p", F.lit(2)).count() == 1
    got = temporal.prior_period(df, key=["k"], period="p", values=["v"])
    assert {r["p"]: r["prior1_v"] for r in got.collect()} == {1: None, 2: 10, 4: None}


@pytest.mark.parametrize("hot", [2, 100])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(spark, hot, how):
    left = spark.createDataFrame([(i, "h" if i % 3 else f"k{i}") for i in range(60)] + [(99, None)], "id int, k string")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("k3", 3), (None, 4)], "k string, v int")
    got, want = salted_join(left, right, ["k"], ["id"], how, hot), left.join(right, "k", how)
    assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, want.select("id", "k", "v").collect()))


@pytest.mark.parametrize("slice_rows", [20, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_sliced_rank_is_row_number(spark, descending, slice_rows):
    rng = random.Random(1)
    rows = [("a" if i % 4 else "b", rng.choice([None, 1.0, 2.0, 3.5, float(i % 17)]), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = {r["id"]: r["rank"] for r in ranking.sliced_rank(df, by=["g"], value="v", tie="id", slice_rows=slice_rows, descending=descending).collect()}
    for g in "ab":
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, (-r[1] if descending else r[1]) if r[1] is not None else 0, r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("slice_rows", [15, 10**6])
def test_quantiles_and_totals_in_slices(spark, slice_rows):
    import numpy as np

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(30)), rng.random()]), i) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    mine = lambda g: sorted((v, i) for k, v, i in rows if k == g and v is not None)
    for r in ranking.quantiles(df, by=["g"], value="v", at={"p10": 0.1, "p50": 0.5}, slice_rows=slice_rows).collect():
        assert np.allclose([r["p10"], r["p50"]], np.quantile([v for v, _ in mine(r["g"])], [0.1, 0.5]))
    t = ranking.sliced_totals(df.where("v is not null"), by=["g"], value="v", tie=["id"], totals={"s": F.col("id").cast("long")}, size="n", slice_rows=slice_rows, descending=False)
    for g in ("a", "b", None):
        got = sorted((r["v"], r["id"], r["s"], r["n"]) for r in t.collect() if r["g"] == g)
        assert [x[2] for x in got] == np.cumsum([i for _, i in mine(g)]).tolist() and {x[3] for x in got} == {len(mine(g))}


def test_tolerance_pairs_is_brute_force(spark):
    rng = random.Random(2)
    rows = [("g", i, round(rng.uniform(1, 40), 2)) for i in range(80)] + [("g", 200, 0.0), ("g", 201, None)]
    got = matching.tolerance_pairs(spark.createDataFrame(rows, "g string, id int, v double"), by=["g"], id="id", value="v", tolerance=0.05)
    want = {(a[1], b[1]) for a in rows for b in rows if a[2] and b[2] and (a[2], a[1]) < (b[2], b[1]) and b[2] - a[2] <= 0.05 * b[2]}
    assert {(r["a"], r["b"]) for r in got.collect()} == want
    free = {(r["a"], r["b"]) for r in matching.greedy_disjoint(got, by=["g"], order=["value_a"]).collect()}
    used, first = set(), set()
    for _, a, b in sorted((r["value_a"], r["a"], r["b"]) for r in got.collect()):
        if not {a, b} & used:
            used |= {a, b}
            first.add((a, b))
    assert free == first
    assert matching.greedy_disjoint(got.where("false"), by=["g"], order=["a"]).count() == 0


def test_reliability_has_empty_bins_and_closed_top(spark):
    df = spark.createDataFrame([(1.0, 1), (0.05, 0), (0.95, 1)], "p double, y int")
    bins = {r["bin"]: r["n"] for r in metrics.reliability(df, "p", "y").collect()}
    assert len(bins) == 10 and bins[9] == 2 and bins[0] == 1 and bins[5] == 0


def test_isotonic_curve_never_rises(spark):
    rng = random.Random(5)
    rows = [("c", i, rng.uniform(0, 10), rng.randrange(1, 5)) for i in range(15)]
    fit = [r["fit"] for r in metrics.isotonic_decreasing(spark.createDataFrame(rows, "c string, x int, v double, w int"), by=["c"], x="x", value="v", weight="w").orderBy("x").collect()]
    assert all(a >= b - 1e-9 for a, b in zip(fit, fit[1:]))
    assert abs(sum(f * r[3] for f, r in zip(fit, rows)) - sum(r[2] * r[3] for r in rows)) < 1e-6


def test_half_up_and_scores(spark):
    one = spark.range(1)
    assert one.select(half_up(F.lit(0.125), 2)).first()[0] == 0.13
    assert one.select(scoring.number(F.lit("NA")), scoring.number(F.lit("")), scoring.number(F.lit("1.5"))).first()[:] == (0.0, 0.0, 1.5)
    with pytest.raises(ValueError, match="unknown"):
        scoring.Scoring({"a": 1.0}, {"QB": {"b": 2.0}})
    with pytest.raises(Exception, match="odds of 0"):
        one.select(scoring.american_odds(F.lit(0))).collect()
    assert abs(one.select(scoring.normal_cdf(F.lit(1.96))).first()[0] - 0.975) < 1e-4


def test_lineup_and_replacement(spark):
    rows = [("t", p, i, float(20 - i)) for i, p in enumerate(["QB", "QB", "RB", "RB", "WR", "WR", "WR"])]
    df = spark.createDataFrame(rows, "team string, pos string, id int, v double")
    got = valuation.lineup(df, by=["team"], position="pos", order=[F.col("v").desc(), "id"], slots={"QB": 1, "RB": 1, "WR": 1}, flex=["RB", "WR"], flex_slots=1)
    assert {r["id"]: r["role"] for r in got.collect()} == {0: "QB", 2: "RB", 4: "WR", 3: "FLEX"}
    level = valuation.replacement(df, by=["team"], position="pos", value="v", id="id", slots={"QB": 1, "RB": 1, "WR": 1}, flex=["RB", "WR"], flex_slots=1)
    assert {r["pos"]: r["replacement"] for r in level.collect()} == {"QB": 19.0, "RB": 17.0, "WR": 15.0}
