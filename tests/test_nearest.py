"""Vector search over all rows, against brute force."""

from __future__ import annotations

import math
import random

import pytest

from pointgate.operators.nearest import cosine_topk
from pointgate.plans import load
from pointgate.plans.registry import QUERIES

load()


def rows() -> list[tuple]:
    rng = random.Random(3)
    out = [(i, [rng.gauss(0, 1) for _ in range(6)], [None, "hot", "b"][min(i % 5, 2)]) for i in range(90)]
    return out + [(90, out[20][1], "other"), (91, out[20][1], None), (92, [0.0] * 6, "b"), (93, None, "b")]


def brute(data: list[tuple]) -> set[tuple]:
    good = [(i, v) for i, v, _ in data if v and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    return {(q, i) for q, a in good if q % 20 == 0 for i, _ in sorted(((i, round(cos(a, b), 7)) for i, b in good if i != q), key=lambda t: (-t[1], t[0]))[:5]}


@pytest.mark.parametrize("block", [7, 1000])
def test_blocks_give_the_nearest(spark, block):
    e = spark.createDataFrame(rows(), "vec_id long, embedding array<double>, label string")
    got = cosine_topk(e.where("vec_id % 20 = 0"), e, id="vec_id", vector="embedding", k=5, block=block).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == brute(rows()) and len(got) == 25


def test_other_labels_are_found(spark, tmp_path):
    spark.createDataFrame(rows(), "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["embedding_topk_all"](spark, str(tmp_path)).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == brute(rows())
    assert {r["vec_id"] for r in got if r["query_id"] == 20} >= {90, 91}
