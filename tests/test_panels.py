"""Pairs against plain searches, and sources that refuse."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointgate.plans.panels import nearest_free, seeded_pairs
from pointgate.sources import guarded


def test_nearest_free_is_the_plain_search():
    for seed in range(30):
        rng = random.Random(seed)
        hits, others = [[(rng.randrange(30), f"{side}{i}") for i in range(rng.randrange(0, 15))] for side in "ho"]
        want, used = [], set()
        for rank, a in sorted(hits):
            near = min(((abs(r - rank), b) for r, b in others if b not in used), default=None)
            if near:
                used.add(near[1])
                want.append((a, near[1], near[0]))
        assert nearest_free(hits, others) == want


def test_seeded_pairs():
    rng = random.Random(1)
    rows = pd.DataFrame({"id": [f"p{i}" for i in range(60)], "v": [rng.uniform(5, 30) for _ in range(60)], "out": [rng.random() for _ in range(60)]})
    v = dict(zip(rows["id"], rows["v"]))
    got = seeded_pairs(rows, "s", 0.2)
    ends = [x for a, b, _ in got for x in (a, b)]
    assert len(set(ends)) == len(ends) > 40 and all(abs(v[a] - v[b]) <= 0.2 * max(v[a], v[b]) for a, b, _ in got)
    free = [x for x in v if x not in ends]
    assert all(abs(v[a] - v[b]) > 0.2 * max(v[a], v[b]) for a in free for b in free if a != b)
    assert got == seeded_pairs(rows.sample(frac=1, random_state=2), "s", 0.2) != seeded_pairs(rows, "t", 0.2)


def test_sources_refuse(spark, tmp_path):
    folder = str(tmp_path / "lines")
    spark.createDataFrame([('{"a": 1}',), ('{"a": 2}',)], "value string").write.text(folder)
    pin = guarded.lines_digest(spark, folder)
    assert guarded.pinned_jsonl(spark, folder, "a int", pin).count() == 2
    spark.createDataFrame([('{"a": 2}',)], "value string").write.mode("append").text(folder)
    with pytest.raises(ValueError, match="digest"):
        guarded.pinned_jsonl(spark, folder, "a int", pin)
    df = spark.createDataFrame([(2020, 1), (None, 2), (2024, 3)], "season int, id int")
    assert guarded.unsealed(df.where("id < 3"), "season", [2024]).count() == 2
    with pytest.raises(Exception, match="sealed: 2024"):
        guarded.unsealed(df, "season", [2024]).select(F.sum("season")).collect()
    assert [r[0] for r in df.select(guarded.first_broken([("none", F.col("season").isNotNull()), ("late", F.col("season") < 2022)])).collect()] == ["good", "none", "late"]
