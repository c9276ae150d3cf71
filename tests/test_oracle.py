"""Every query with a SQL twin gives its rows."""

from __future__ import annotations

import pytest
from comparing import agree

from pointgate.plans import load
from pointgate.plans.registry import QUERIES, SQL

load()


def between(*columns, low=0.0, high=1.0):
    def check(rows):
        assert all(low <= r[c] <= high for r in rows for c in columns)

    return check


def once(*columns):
    def check(rows):
        seen = [tuple(r[c] for c in columns) for r in rows]
        assert len(seen) == len(set(seen))

    return check


def both(*checks):
    return lambda rows: [c(rows) for c in checks]


#: Queries that find nothing in tables as small as those of the tests.
SMALL = {"greedy_pairs", "nearest_pairs", "walk_forward_gbt", "nearest_match"}
CELL = ("season", "preset", "slot", "seed", "policy", "supervisor")
#: What holds for the results that no SQL gives.
INVARIANTS = {
    "walk_forward_gbt": both(between("p"), once("season", "player_id")),
    "grouped_oof": both(between("p"), once("season", "player_id"), lambda rows: once("player_id")(list({r["player_id"]: r for r in rows}.values())) or len({(r["player_id"], r["fold"]) for r in rows}) == len({r["player_id"] for r in rows})),
    "threshold_curve": both(between("recall", "accuracy"), lambda rows: [r["taken"] for r in sorted(rows, key=lambda r: r["threshold"])] == sorted((r["taken"] for r in rows), reverse=True) or pytest.fail("more are taken at a higher threshold")),
    "forest_grid": both(once("depth", "trees", "threshold", "band"), lambda rows: len(rows) == 225 and max(rows, key=lambda r: (r["accuracy"] or 0, r["answered"]))["accuracy"] == min(rows, key=lambda r: r["rank"])["accuracy"] or pytest.fail("the first is not the best")),
    "perm_importance": both(between("brier"), once("feature")),
    "draft_sim": both(once(*CELL, "pick"), once(*CELL, "player_id")),
    "draft_benchmark": both(once(*CELL), lambda rows: all(r["delta"] == 0 for r in rows if r["policy"] == "autopick") or pytest.fail("the control differs from itself")),
    "draft_panel": both(once("policy", "supervisor"), between("full"), lambda rows: all(r["wins"] + r["ties"] + r["losses"] == r["n"] for r in rows) or pytest.fail("arms don't add up")),
    "replay_prefix": lambda rows: all(r["same"] for r in rows) or pytest.fail("a replay differs"),
    "expert_traces": lambda rows: "direct" in {r["kind"] for r in rows} <= {"direct", "recovery", "tool_pair"} or pytest.fail("kinds are missing"),
    "simhash_neardup": both(once("class", "other"), between("distance")),
    "jaccard_neardup": both(once("class", "other"), between("jaccard", low=0.8)),
    "nearest_match": both(once("season", "position", "a"), once("season", "position", "b")),
    "fingerprint_dedup_all": once("fp"),
    "embedding_topk_all": between("similarity", low=-1.00001, high=1.00001),
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    agree(spark, duck, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert (rows or name in SMALL) and len(set(df.columns)) == len(df.columns)
    INVARIANTS.get(name, lambda rows: None)(rows)
