"""Components against union-find, in one go and in increments; deficits and quarantine."""

from __future__ import annotations

import random

import pytest

from pointgate.llm import keys
from pointgate.llm.splits import QUARANTINE, Components, fill_deficits


def brute(nodes, edges):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in up}


def run(spark, folder, *updates):
    store = Components(spark, str(folder / "table"))
    for k, edges in enumerate(updates, 1):
        assert store.update(spark.createDataFrame(edges, "a string, b string")) == k
    return store


def resolved(spark, store, nodes, upto=None):
    return {r["node"]: r["component"] for r in store.resolve(spark.createDataFrame([(n,) for n in nodes], "node string"), upto).collect()}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind, tmp_path):
    rng = random.Random(4)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = {
        "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)], "path": [(nodes[i], nodes[i + 1]) for i in range(25)][::-1],
        "star": [("n39", n) for n in nodes[:30]] * 2, "none": [],
    }[kind]
    store = Components(spark, str(tmp_path / "table"))
    assert store.update(spark.createDataFrame(edges + [(None, "n01")], "a string, b string")) == (kind != "none")
    assert resolved(spark, store, nodes + [None]) == brute(nodes, edges)


def test_increments_equal_one_go(spark, tmp_path):
    """Updates that join, extend and leave components alone; earlier states stay; compacting changes nothing."""
    nodes = [f"n{i:02d}" for i in range(20)] + ["new"]
    edges = [("n01", "n02"), ("n03", "n04"), ("n10", "n11"), ("n02", "n10"), ("n04", "n12"), ("n12", "new"), ("n00", "n11"), ("n19", "n03")]
    store = run(spark, tmp_path, edges[:3], edges[3:6])
    assert store.update(spark.createDataFrame([("n02", "n01"), ("n05", None)], "a string, b string")) == 2
    assert store.update(spark.createDataFrame(edges[6:], "a string, b string")) == 3
    for upto, k in ((1, 3), (2, 6), (3, 8), (None, 8)):
        assert resolved(spark, store, nodes, upto) == brute(nodes, edges[:k])
    store.compact()
    assert store.versions() == 1
    assert resolved(spark, store, nodes) == brute(nodes, edges)


def test_an_update_writes_what_it_changes(spark, tmp_path):
    edges = [(f"a{i}", f"a{i + 1}") for i in range(200)]
    store = run(spark, tmp_path, edges, [("a150", "a003"), ("b", "c")], [("a7", "b")])
    assert [store.pointers(v).count() for v in (1, 2, 3)] == [200, 2, 1]


def test_deficits_kept_splits_and_quarantine(spark):
    rng = random.Random(6)
    sizes = [(f"c{i}", rng.choice("xy"), rng.randrange(1, 9)) for i in range(400)] + [("big", "x", 150), ("null", None, 3)]
    shares = spark.createDataFrame([("train", 800_000), ("validation", 100_000), ("test", 100_000)], "split_name string, share_ppm int")
    kept = spark.createDataFrame([("c1", "test"), ("c2", "test"), ("c2", "train")], "component string, split string")
    df = spark.createDataFrame(sizes, "component string, stratum string, n int")
    got = {r["component"]: r["split"] for r in fill_deficits(df, kept, shares, slice_rows=50).collect()}
    assert len(got) == len(sizes) and got["c1"] == "test" and got["c2"] == QUARANTINE and got["big"] == "train"
    for s in "xy":
        total = sum(n for _, t, n in sizes if t == s)
        for split, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
            assert abs(sum(n for c, t, n in sizes if t == s and got[c] == split) - share * total) <= 10
    empty = fill_deficits(df.where("false"), None, shares)
    assert empty.count() == 0


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("t11:2023:q00000004:p00:calibration_correction", "T11 | 2023 | Q4 | P0 | CALIBRATION_CORRECTION", True), ("2015:e4:p02:direct_pick", " T11::2015:e00000004:p02:direct_pick ", True), ("t1:2017:x00000029", "T1/2017/X29", True),
        ("t11:2023:q4:p00:c#1", "t11:2023:q4:p00:c", False), ("t11:2023:q40:p00:c", "t11:2023:q4:p00:c", False), ("t11:2023:q4:p00:c", "t11:2022:q4:p00:c", False), ("t11:2023:e10:p10:c", "t11:2023:e1:p1:c", False),
    ],
)
def test_trace_spellings(spark, duck, a, b, same):
    from pyspark.sql import functions as F

    x, y = spark.createDataFrame([(a, b)], "a string, b string").select(keys.trace_key(F.col("a")), keys.trace_key(F.col("b"))).first()
    assert x and y and (x == y) is same
    for value, want in ((a, x), (b, y)):
        assert duck.execute("SELECT " + keys.TRACE_SQL.format("v") + " FROM (SELECT ? AS v)", [value]).fetchall()[0][0] == want


def test_no_trace(spark):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(None,), ("",), ("none",)], "a string").select(keys.trace_key(F.col("a"))).distinct().collect() == [(None,)]
