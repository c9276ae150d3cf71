"""Queries of the llm package against their SQL twins, and their shapes."""

from __future__ import annotations

import pytest
from comparing import agree

from pointgate.llm.queries import QUERIES, SQL

COLUMNS = {
    "p1_found": ["target_id"], "p3_found": ["row_id_a", "row_id_b"], "p4_found": ["player_id", "nflverse_id"], "p5_found": ["row_id", "group_id"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id_a", "doc_id_b"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    agree(spark, duck, sf_dir, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


def test_splits_keep_groups_together(spark, sf_dir):
    split = {r["row_id"]: r["split"] for r in QUERIES["p5_splits"](spark, sf_dir).collect()}
    for r in QUERIES["p5_found"](spark, sf_dir).collect():
        assert split[r["row_id"]] == split[r["group_id"]]
