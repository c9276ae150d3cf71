"""Every cell of a table in HTML is read back."""

from __future__ import annotations

from pointgate.plans import load
from pointgate.plans.registry import QUERIES

load()
COLUMNS = "season int, player_id string, position string, total_ppr double, games int, pos_season_rank_ppr int"


def test_every_season_and_rank_is_melted(spark, tmp_path):
    rows = [(s, f"p{i}", "WR", 10.0 * i - 20 + s / 1000, 3, i) for s in (1987, 2020, 2044) for i in range(1, 9)] + [(2020, "none", "WR", None, 1, 99), (None, "p1", "WR", 5.0, 1, 1)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/season_points.parquet")
    want = {(s, p, round(x, 2)) for s, p, _, x, _, _ in rows if s and x is not None}
    rows_of = lambda name: {(r["season"], r["player_id"], r["ppr"]) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert rows_of("html_table_melt_all") == want and len(want) == 24
    assert rows_of("html_table_melt") == {x for x in want if x[1] in ("p1", "p2", "p3", "p4", "p5") and x[2] >= 0}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/season_points.parquet")
    assert QUERIES["html_table_melt_all"](spark, str(tmp_path)).count() == 0
