"""Pairs by edit distance, against brute force."""

from __future__ import annotations

import random

from pointgate.operators.near import edit_pairs
from pointgate.plans import load
from pointgate.plans.registry import QUERIES

load()


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng: random.Random, t: str, n: int) -> str:
    for _ in range(n):
        i, c = rng.randrange(len(t) + 1), rng.choice("abé")
        t = rng.choice([t[:i] + c + t[i:], t[:i] + t[i + 1 :], t[:i] + c + t[i + 1 :]])
    return t


def test_every_pair_is_found(spark):
    rng = random.Random(5)
    texts = ["", "a", "b"]
    for n in (9, 10, 11, 19, 20, 29, 30, 47, 60):
        for _ in range(4):
            t = "".join(rng.choice("abé") for _ in range(n))
            texts += [t] + [edited(rng, t, k) for k in range(1, 8)]
    rows = [(("x", "y")[i % 7 == 0], i, t) for i, t in enumerate(texts)] + [("x", 10_000, None), (None, 10_001, "a")]
    got = edit_pairs(spark.createDataFrame(rows, "g string, id long, t string"), by=["g"], id="id", text="t").collect()
    want = {(g, i, j, d) for g, i, s in rows for h, j, t in rows if g and g == h and i < j and s is not None and t is not None and (d := levenshtein(s, t)) <= max(len(s), len(t)) // 10}
    assert {(r["g"], r["a"], r["b"], r["distance"]) for r in got} == want and len(got) == len(want) > 100


def test_first_letters_may_differ(spark, tmp_path):
    m = lambda t: [("user", "?"), ("assistant", t)]
    rows = [(1, "s", "f", m("Xhe pick is P100 today")), (2, "s", "f", m("the  pick is p100 today")), (3, "s", "f", m("THE pick is P100 today")), (4, None, "s", m("the pick is P101 today")), (5, None, "f", m("the pick is P101 today")), (6, "s", "f", m("nothing like it"))]
    spark.createDataFrame(rows, "row_id long, t11_subtype string, family string, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/t11_targeted_v1.parquet")
    got = QUERIES["response_pairs"](spark, str(tmp_path)).collect()
    assert {(r["subtype"], r["a"], r["b"], r["distance"]) for r in got} == {("s", 1, 2, 1), ("s", 2, 4, 1), ("s", 1, 4, 2)}
