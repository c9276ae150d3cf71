"""Dyadic intervals against brute force, and the edge cases of facts and events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pointgate.operators.intervals import as_known, cover, enclosing, levels_of, supersede
from pointgate.plans.known_at import moment_of


def test_cover_tiles_every_interval(spark):
    rows = [(s, e) for s in range(17) for e in range(s, 17)]
    df = spark.createDataFrame(rows, "s long, e long").select("s", "e", cover(F.col("s"), F.col("e"), 4).alias("n"))
    for s, e, nodes in df.collect():
        held = sorted(x for level, node in nodes for x in range(node << level, (node + 1) << level))
        assert held == list(range(s, e))
        assert len(nodes) <= 8


def test_one_enclosing_node_of_each_level(spark):
    got = spark.range(1).select(enclosing(F.lit(5).cast("long"), 3).alias("n")).first()["n"]
    assert [tuple(x) for x in got] == [(0, 5), (1, 2), (2, 1), (3, 0)]


@pytest.mark.parametrize("hot_rows", [3, 1_000_000])
def test_as_known_is_brute_force(spark, hot_rows):
    rng = random.Random(3)
    facts = [(rng.choice("abc"), rng.randrange(30), rng.randrange(10), i) for i in range(60)]
    events = [(i, rng.choice("abcd"), rng.randrange(32)) for i in range(80)]
    f = supersede(spark.createDataFrame(facts, "key string, since long, rank int, id int"), "key", "since", ["rank", "id"], 32)
    e = spark.createDataFrame(events, "event int, key string, t long")
    got = as_known(e, f, key="key", event_id="event", time="t", start="since", end="_until", precedence=["rank", "id"], levels=5, hot_rows=hot_rows)
    want = {i: max((r, d) for k2, s, r, d in facts if k2 == k and s <= t) for i, k, t in events if any(k2 == k and s <= t for k2, s, _, _ in facts)}
    assert {r["event"]: (r["rank"], r["id"]) for r in got.collect()} == want


def test_overlaps_go_to_the_first_in_precedence(spark):
    f = spark.createDataFrame([("a", 0, 10, 1, "x"), ("a", 2, 5, 2, "y"), ("a", 4, None, 1, "z")], "key string, s long, e long, rank int, event string")
    e = spark.createDataFrame([(1, "a", 0), (2, "a", 2), (3, "a", 5), (4, "a", 15), (5, None, 3), (6, "a", None), (7, "b", 3)], "event int, key string, t long")
    got = as_known(e.withColumnRenamed("event", "id"), f, key="key", event_id="id", time="t", start="s", end="e", precedence=["rank", "event"], levels=4)
    assert {r["id"]: r["event"] for r in got.collect()} == {1: "x", 2: "y", 3: "z", 4: "z"}


def test_events_beyond_the_grid_fail(spark):
    """The last moment of the grid is answered; one beyond is an error and never a lost row."""
    assert [levels_of(n) for n in (0, 1, 2, 3, 1024, 1025)] == [1, 1, 1, 2, 10, 11]
    f = spark.createDataFrame([("a", 0, None, 1)], "key string, s long, e long, rank int")
    known = lambda t, levels: as_known(spark.createDataFrame([(1, "a", t)], "event int, key string, t long"), f, key="key", event_id="event", time="t", start="s", end="e", precedence=["rank"], levels=levels)
    assert known(1023, 10).count() == 1 and known(1024, levels_of(1025)).count() == 1
    with pytest.raises(Exception, match="outside of the grid"):
        known(1024, 10).collect()


def test_empty_tables(spark):
    f = spark.createDataFrame([], "key string, since long, rank int, id int")
    e = spark.createDataFrame([], "event int, key string, t long")
    got = as_known(e, supersede(f, "key", "since", ["rank", "id"], 16), key="key", event_id="event", time="t", start="since", end="_until", precedence=["rank", "id"], levels=4)
    assert got.columns == ["event", "rank", "id"] and got.count() == 0


@pytest.mark.parametrize(
    ("text", "season", "week", "want"),
    [
        ("tenth week of 2020", None, None, (2020, 10)), ("[S2022 WK 10] x", None, None, (2022, 10)), ("x (2019-wk-6)", None, None, (2019, 6)), ("W6/2021: x", None, None, (2021, 6)), ("wk8 '20: x", None, None, (2020, 8)),
        ("(WEEK FOURTH (2018)).", None, None, (2018, 4)), ("the 2015 campaign, game week 13", None, None, (2015, 13)), ("Week 5, 2023 season", None, None, (2023, 5)), ("season 2017 / week no. 10", None, None, (2017, 10)),
        ("sat out week 9", None, None, None), (None, None, None, None), ("", None, None, None), ("W1/2019, then W2/2020", 2020, None, (2020, 2)), ("W1/2019, then W2/2020", None, None, (2019, 1)),
    ],
)
def test_moments_in_texts(spark, text, season, week, want):
    df = spark.createDataFrame([(text, season, week)], "text string, season int, week int")
    got = df.select(moment_of(F.col("text"), F.col("season"), F.col("week")).alias("m")).first()["m"]
    assert (tuple(got) if got else None) == want


def test_weeks_see_only_what_was_loaded_before(spark):
    """Brute force over invented games and depth rows, also from before the first week."""
    from datetime import date, datetime, timedelta

    from pointgate.plans.known_at import depth_facts, week_grid

    rng = random.Random(9)
    weeks = [(s, w, date(s, 9, 1) + timedelta(days=7 * w + rng.randrange(3))) for s in (2020, 2021) for w in (1, 2, 4, 5)]
    games = spark.createDataFrame(weeks + [(2020, 1, date(2020, 12, 1)), (2020, None, date(2020, 1, 1))], "season int, week int, gameday date")
    at = lambda: datetime(2020, 8, 25) + timedelta(hours=rng.choice([0, 5, 24 * rng.randrange(420)]))
    rows = [("p", rng.choice([2017, 2020, 2021]), rng.randrange(1, 7), at() if rng.random() < 0.9 else datetime(2015, 1, 1), i) for i in range(40)]
    weekly = spark.createDataFrame(rows + [(None, 2020, 1, at(), 90), ("p", None, 1, at(), 91), ("p", 2020, 1, None, 92)], "gsis_id string, season int, week int, loaded_at timestamp_ntz, depth_id int")
    dated = [("q", at(), at(), 100 + i) for i in range(30)]
    snapshot = spark.createDataFrame(dated, "gsis_id string, dt timestamp_ntz, loaded_at timestamp_ntz, depth_id int")
    grid = week_grid(games)
    order = ["rank", "loaded_at", "depth_id"]
    facts = supersede(depth_facts(weekly, snapshot, grid), "player", "since", order, 8)
    events = grid.selectExpr("season * 64 + week AS event", "t", "explode(array('p', 'q')) AS player").selectExpr("event * 2 + int(player = 'q') AS event", "t", "player")
    got = as_known(events, facts, key="player", event_id="event", time="t", start="since", end="_until", precedence=order, levels=3)
    want = {}
    for s, w, d in weeks:
        cutoff = datetime(d.year, d.month, d.day)
        p = [(r[1] * 64 + r[2], r[3], r[4]) for r in rows if (r[1], r[2]) <= (s, w) and r[3] < cutoff]
        q = [(r[1], r[2], r[3]) for r in dated if r[1] < cutoff and r[2] < cutoff]
        for k, x in ((0, p), (1, q)):
            if x:
                want[(s * 64 + w) * 2 + k] = max(x)[2]
    assert {r["event"]: r["depth_id"] for r in got.collect()} == want
