"""Replies, ranges and rounding against Python's own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pointgate.functions import ranges, replies
from pointgate.functions.scalar import half_even
from pointgate.plans.ledgers import reconciled, usage_by_kind
from pointgate.sources.files import replace_atomically


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<think>{"pick": "no"}</think> I take {"pick": "P1", "why": "a } in {text}"} and {"pick": "P2"}', ("pick", "P1", None)), ('{"tool": {"name": "news", "arguments": {"player": "P3"}}}', ("tool", None, "news")),
        ('{"other": 1}', ("invalid", None, None)), ("no object {", ("none", None, None)), (None, ("none", None, None)), ('x {"pick": 7} y', ("pick", "7", None)), ('{"a": {"b": {"c": "\\\\"}}, "pick": "q\\"}"}', ("pick", 'q"}', None)),
    ],
)
def test_actions(spark, text, want):
    x = one(spark, text, replies.action)
    assert (x["kind"], x["pick"], x["tool"]) == want


def test_answers(spark):
    asked = F.array(*map(F.lit, ("a", "b", "c", "d")))
    get = lambda t: one(spark, t, lambda c: replies.answers(c, asked))
    x = get('<think>[1]</think>So: [{"question_id": "a", "p": 1.7}, {"question_id": "b", "p": "0.25"}, {"question_id": "a", "p": 0.1}, {"question_id": "zz", "p": 0.5}, {"question_id": "c", "p": null}] done')
    assert [tuple(a) for a in x["answers"]] == [("a", 1.0), ("b", 0.25)] and x["coverage"] == 0.5 and x["ok"]
    loose = get('[{"question_id": "a", "p": 0.3}, {"question_id": "b", "p": 0.4}, {"question_id": "c", "p": 0.9')
    assert [tuple(a) for a in loose["answers"]] == [("a", 0.3), ("b", 0.4), ("c", 0.9)] and loose["ok"]
    assert not get('[{"question_id": "a", "p": 0.3}]')["ok"] and not get("nothing")["ok"] and not get(None)["ok"]


def test_observations_and_dates(spark):
    text = 'Draft on.\nOBSERVATION: {"round": 3, "top": [{"id": "x", "adp": 1.5}]} Reply with JSON {"pick"}'
    assert one(spark, text, lambda c: replies.observation(c, "OBSERVATION:", "round int, top array<struct<id string, adp double>>")).asDict(True) == {"round": 3, "top": [{"id": "x", "adp": 1.5}]}
    assert one(spark, "none here {}", lambda c: replies.observation(c, "OBSERVATION:", "round int")) is None
    doc = '{"a": [{"published_utc": "2020-09-01T00:00:00Z", "b": {"snapshot": "2020-08-31"}}, {"snapshot": "2021-01-01"}], "snapshot": "later", "text": "\\"snapshot\\": \\"2022-01-01\\""}'
    assert one(spark, doc, lambda c: replies.future_dates(c, F.lit("2020-09-01").cast("date"))) == ["2020-09-01T00:00:00Z", "2021-01-01"]


def test_anchor(spark):
    get = lambda *rates: tuple(spark.range(1).select(replies.anchor([(F.lit(r).cast("double"), F.lit(n)) for r, n in rates]).alias("x")).first()["x"])
    assert get((0.1, 5), (0.2, 30), (0.3, 90)) == (0.2, 30) and get((0.1, 5), (0.2, 9), (None, 90)) == (0.2, 9)
    assert get((0.1, 9), (0.2, 9)) == (0.1, 9) and get((None, 3), (None, 0)) == (None, 0)


def test_ranges(spark):
    assert ranges.numbers("2015-2018, 2021,") == [2015, 2016, 2017, 2018, 2021] and ranges.numbers("-3--1,5") == [-3, -2, -1, 5]
    with pytest.raises(ValueError):
        ranges.numbers("x")
    df = spark.createDataFrame([("2015-2018,2021",), ("-2-1, 7",), ("",), (None,), ("9-1,x,3",)], "t string")
    assert [r[0] for r in df.select(ranges.whole_numbers(F.col("t"))).collect()] == [[2015, 2016, 2017, 2018, 2021], [-2, -1, 0, 1, 7], [], None, [3]]
    assert spark.range(10).where(ranges.in_ranges(F.col("id"), "1-3,8")).count() == 4


def test_half_even_is_round(spark):
    rng = random.Random(2)
    values = [2.675, 0.5, 1.5, 2.5, 0.125, -0.125, 1.005, -2.675, 0.0, 1e9 + 0.125, 0.045, None] + [rng.uniform(-500, 500) for _ in range(400)] + [rng.randrange(-4000, 4000) / 8 for _ in range(200)] + [rng.randrange(10**6) / 1000 + 0.0005 for _ in range(200)]
    for digits in (2, 4):
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even(F.col("v"), digits).alias("r")).collect()
        assert [r["r"] for r in got] == [None if r["v"] is None else round(r["v"], digits) for r in got]


def test_guards(spark, tmp_path):
    e = spark.createDataFrame([("a", 1.0, 1), ("b", None, 1), ("z", 2.0, 2)], "kind string, v double, day int").selectExpr("*", "make_timestamp_ntz(2024, 1, day, 0, 0, 0) AS at")
    use = lambda end: usage_by_kind(e, kind="kind", amount="v", at="at", start="2024-01-01", end=end, kinds={"a": "x", "b": None}, by=["day"]).collect()
    assert [tuple(r) for r in use("2024-01-02")] == [(1, 1.0)]
    with pytest.raises(Exception, match="unexpected kind of event: z"):
        use("2024-01-03")
    p, c = spark.createDataFrame([("k", 5), (None, 1)], "k string, v int"), spark.createDataFrame([("k", 3)], "k string, v int")
    assert {tuple(r) for r in reconciled(p, c, key="k", value="v").collect()} == {("k", 5, 3, 2), (None, 1, 0, 1)}
    with pytest.raises(Exception, match="more completed than provided: k"):
        reconciled(c, p, key="k", value="v").collect()
    path = str(tmp_path / "t")
    for n in (3, 5):
        replace_atomically(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["t"]
