"""Leaks against planted passages and edge cases."""

from __future__ import annotations

import random

import pytest

from pointgate.llm.leaks import held_share, leaks
from pointgate.llm.lookalikes import folded_words

RNG = random.Random(11)
WORDS = [f"word{i}" for i in range(600)]
ITEM = [RNG.choice(WORDS) for _ in range(100)]
FILL = [f"fill{i}" for i in range(300)]


def passage(words, change=0):
    words = list(words)
    for k in range(change):
        words[(k + 1) * len(words) // (change + 1) - 1] = f"changed{k}"
    return words


DOCS = {
    1: ITEM, 2: FILL[:50] + ITEM[20:62] + FILL[50:90], 3: FILL[:20] + ITEM[5:30] + FILL[20:80] + ITEM[60:82], 4: FILL[:30] + ITEM[:25], 5: passage(ITEM[10:70], 6),
    6: FILL, 7: [w.upper() for w in ITEM[:45]], 8: ITEM[:30] + ["extra"] + ITEM[30:60], 9: ITEM[60:85] + FILL[:9] + ITEM[5:12],
}
LEAKING = {1, 2, 3, 5, 7, 8}


@pytest.mark.parametrize("seeds", [10**6, 0])
def test_planted_passages(spark, seeds):
    docs = spark.createDataFrame([(i, " ".join(w), 5) for i, w in DOCS.items()] + [(1, " ".join(ITEM), 5), (90, None, 1), (91, "", 1), (None, "x", 1)], "id int, text string, share int")
    items = spark.createDataFrame([(1, ", ".join(ITEM)), (2, " ".join(FILL[200:])), (3, None), (4, ""), (5, " ".join(ITEM))], "id int, text string")
    got = leaks(docs, items, document="id", item="id", broadcast_seeds=seeds)
    assert got.columns == ["id", "item_id", "share"]
    rows = got.collect()
    assert len(rows) == len({(r["id"], r["item_id"]) for r in rows})
    assert {(r["id"], r["item_id"]) for r in rows} == {(i, k) for i in LEAKING for k in (1, 5)} | {(6, 2)}


def dense(words, every, how):
    out = []
    for k, w in enumerate(words):
        edit = k % every == every - 1
        if how == "added":
            out += [w, f"new{k}"] if edit else [w]
        elif how == "changed":
            out.append(f"new{k}" if edit else w)
        elif not edit:
            out.append(w)
    return out


def test_dense_edits(spark):
    """Words added after, put in place of, or left out after every second to fourth word."""
    cases = [(e, h) for h in ("added", "changed", "left out") for e in (2, 3, 4)]
    texts = [dense(ITEM, e, h) for e, h in cases]
    docs = spark.createDataFrame([(i, " ".join(FILL[:20] + t)) for i, t in enumerate(texts)], "id int, text string")
    items = spark.createDataFrame([(1, " ".join(ITEM))], "item int, text string")
    got = {r["id"]: r["share"] for r in leaks(docs, items, document="id", item="item").collect()}
    # Runs of single words are no stretch; every other case is one.
    assert set(got) == {i for i, (e, h) in enumerate(cases) if (e, h) not in ((2, "changed"), (2, "left out"))}
    assert all(got[i] > 0.45 for i in got)


def test_same_as_all_pairs(spark):
    """Against the comparison of every document with every item, on texts that share moulds."""
    import numpy as np

    rng = random.Random(3)
    moulds = [[rng.choice(WORDS) for _ in range(12)] for _ in range(6)]
    text = lambda n: [w for _ in range(n) for w in (rng.choice(moulds)[:8] + [rng.choice(WORDS) for _ in range(6)])]
    items = {k: text(rng.randint(1, 6)) for k in range(12)}
    docs = {}
    for d in range(80):
        item = items[rng.randrange(12)]
        a, n = rng.randrange(len(item)), rng.randint(3, len(item))
        docs[d] = text(2) + passage(item[a : a + n], rng.randint(0, n // 5)) + text(1) + item[: rng.randint(0, len(item) // 3)]
    number = {w: k for k, w in enumerate(sorted({w for x in [*docs.values(), *items.values()] for w in x}))}
    ids = lambda words: np.array([number[w] for w in words])
    want = {(d, i) for d, x in docs.items() for i, y in items.items() if held_share(ids(y), ids(x)) >= 0.4 - 1e-9}
    frame = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], f"{key} int, text string")
    for seeds in (10**6, 0):
        got = {(r["id"], r["item"]) for r in leaks(frame(docs, "id"), frame(items, "item"), document="id", item="item", broadcast_seeds=seeds).collect()}
        assert got == want and len(want) > 40


def test_short_items_and_long_documents(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, " ".join(FILL * 60 + ["alpha", "beta"])), (3, "zero")], "id int, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "alpha beta gamma")], "item int, text string")
    assert {(r["id"], r["item"]) for r in leaks(docs, items, document="id", item="item").collect()} == {(1, 1), (2, 2)}


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b c")], "id int, text string"), spark.createDataFrame([], "id int, text string")
    for seeds in (10**6, -1):
        assert leaks(none, some, document="id", item="id", broadcast_seeds=seeds).count() == 0
        assert leaks(some, none, document="id", item="id", broadcast_seeds=seeds).count() == 0


def test_look_alikes_fold():
    assert folded_words("\u0420\u0435\u200bt\u0435r, nai\u0308ve\u00a0\u2009\uff26\uff35\uff2c\uff2c") == ["peter", "naive", "full"]
    assert folded_words(None) == [] and folded_words("\u2026") == []


def test_order_of_stretches_counts():
    import numpy as np

    item = np.arange(1, 101)
    assert held_share(item, np.concatenate([item[:25], np.zeros(30, int), item[50:75]])) == pytest.approx(0.5)
    assert held_share(item, np.concatenate([item[50:75], np.zeros(30, int), item[:25]])) == pytest.approx(0.25)


def test_words_met_by_chance_at_a_break():
    """A passage parted by a sentence that begins with the word that would have come next."""
    import numpy as np

    item = np.arange(1, 101)
    text = np.concatenate([item[:30], [31], np.zeros(20, int), item[30:60]])
    assert held_share(item, text) == pytest.approx(0.6)
