"""Near-duplicates by 5-word shingles, against brute force."""

from __future__ import annotations

import random

from pointgate.operators import near
from pointgate.operators.near import jaccard_pairs
from pointgate.plans import load
from pointgate.plans.registry import QUERIES
from pointgate.session import cut

load()


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b)


def test_every_set_pair_is_found(spark):
    rng = random.Random(2)
    sets = []
    for i in range(60):
        s = set(rng.sample(range(40), rng.randrange(1, 30))) | {7, 8}
        sets += [s] + [set(rng.sample(sorted(s), max(1, len(s) - k))) | set(rng.sample(range(40, 60), k // 2)) for k in (1, 2, 3, 4)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(9999, [])], "id long, s array<long>")
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and jaccard(a, b) >= 0.8}
    for common in (1, 1000):
        got = jaccard_pairs(df, id="id", items="s", common=common).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want) > 60


def test_texts_of_other_length_and_hash_are_found(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words + ["more", "words", "follow", "here"]), " ".join(words[:57]).upper(), " ".join(words[::-1]), "one two", "One, two!", "...", None, " ".join(words)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["jaccard_neardup"](spark, str(tmp_path)).collect()
    assert {(r["class"], r["other"], r["jaccard"]) for r in got} == {(0, 1, round(56 / 60, 6)), (0, 2, round(53 / 56, 6)), (1, 2, round(53 / 60, 6)), (4, 5, 1.0)}


def test_only_sets_with_a_likeness_are_kept(spark, monkeypatch):
    rng, seen = random.Random(5), []
    sets = [{rng.getrandbits(62) for _ in range(60)} for _ in range(400)]
    sets += [set(sorted(sets[k])[:55]) for k in (3, 7)]
    monkeypatch.setattr(near, "cut", lambda df: (out := cut(df), seen.append(out.count()))[0])
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, s array<long>")
    for steer in ({}, {"broadcast_ids": 0}):
        assert {(r["a"], r["b"], round(r["jaccard"], 6)) for r in jaccard_pairs(df, id="id", items="s", **steer).collect()} == {(3, 400, round(55 / 60, 6)), (7, 401, round(55 / 60, 6))}
    # Items of one set only make no rows, and sets without a candidate are not written; a few slots collide.
    assert len(seen) == 8 and max(seen) < 200
    assert {(r["a"], r["b"]) for r in jaccard_pairs(df, id="id", items="s", filter_bits=10).collect()} == {(3, 400), (7, 401)}
