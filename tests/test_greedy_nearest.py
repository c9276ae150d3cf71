"""Closest pairs first, against a pass over all pairs."""

from __future__ import annotations

import random

import pytest

from pointgate.operators.matching import closest_first
from pointgate.plans import load
from pointgate.plans.registry import QUERIES

load()


def brute(left: list[tuple], right: list[tuple], within: float) -> set[tuple]:
    used, out = set(), set()
    for d, a, b in sorted((abs(v - w), a, b) for v, a in left for w, b in right if abs(v - w) <= within):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b, d))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_closest_first_is_the_pass_over_all_pairs(seed):
    rng = random.Random(seed)
    top = rng.choice([2, 20, 300])
    side = lambda name: [(round(rng.uniform(0, top), rng.choice([0, 2])), f"{name}{i}") for i in rng.sample(range(999), rng.randrange(0, 90))]
    left, right = side("a"), side("b")
    got = closest_first(left, right, 25)
    assert set(got) == brute(left, right, 25) and len(got) == len(set(got))


def test_nearest_match_makes_no_table_of_pairs(spark, tmp_path):
    rng = random.Random(1)
    rows = [(2020 + i % 2, f"p{i:03}", "RB", rng.choice(["A/B", "A"]), round(rng.uniform(0, 200), 2)) for i in range(400)]
    odd = [(2020, "n0", "RB", "A/B", None), (2020, "n1", "RB", None, 3.0), (None, "n2", "RB", "A/B", 3.0), (2020, None, "RB", "A/B", 3.0), (2020, "n3", "RB", "A/B", float("nan")), (2020, "p000", "RB", "A", 0.0)]
    spark.createDataFrame(rows + odd, "season int, player_id string, position string, team string, total_ppr double").write.parquet(f"{tmp_path}/season_points.parquet")
    df = QUERIES["nearest_match"](spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    want = set()
    for season in (2020, 2021):
        here = [r for r in rows if r[0] == season]
        want |= {(season, a, b, round(d, 2)) for a, b, d in brute([(r[4], r[1]) for r in here if r[3] == "A/B"], [(r[4], r[1]) for r in here if r[3] == "A"], 25)}
    assert {(r["season"], r["a"], r["b"], r["distance"]) for r in df.collect()} == want and len(want) > 100
