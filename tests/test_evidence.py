"""The document index: early exit, buckets, and digests that notice a change."""

from __future__ import annotations

import shutil
from pathlib import Path

from pyspark.sql import functions as F

from pointgate.sources import evidence as ev

YEAR = 31_556_952_000


def build(spark, folder):
    rows = [(i, f"e{i % 5}" if i % 7 else None, f"News {i} about THE week {'rain' if i % 2 else 'sun'}", (45 + i % 10) * YEAR + YEAR // 2 + i) for i in range(60)] + [(99, "e1", "no time: the week", None), (98, "e1", None, 50 * YEAR)]
    df = spark.createDataFrame(rows, "id int, who string, text string, ms long")
    ev.write_evidence(df, folder, id="id", at_ms="ms", entity="who", digest=["id", "text"])
    return rows


def test_search_and_entities(spark, tmp_path):
    folder = str(tmp_path / "x")
    rows = build(spark, folder)
    find = lambda **k: [r["id"] for r in ev.search(spark, folder, text=F.col("text"), id="id", at_ms="ms", **k).collect()]
    hit = lambda limit, before=1 << 60: [i for i, _, t, ms in sorted((r for r in rows if r[3] is not None and r[3] < before and r[2] and "the week" in r[2].lower() and "rain" in r[2]), key=lambda r: (-r[3], r[0]))][:limit]
    for limit in (1, 7, 100):
        assert find(terms=["the week", "Rain"], limit=limit) == hit(limit)
    assert find(terms=["rain", "the week"], limit=5, before_ms=50 * YEAR) == hit(5, 50 * YEAR)
    assert find(terms=["nowhere"], limit=5) == [] and find(terms=[], limit=5, before_ms=0) == []
    assert {r["id"] for r in ev.of_entity(spark, folder, "who", "e1").collect()} == {r[0] for r in rows if r[1] == "e1"}
    assert ev.of_entity(spark, folder, "who", "nobody").count() == 0


def test_early_exit_leaves_older_years_alone(spark, tmp_path):
    folder = str(tmp_path / "x")
    build(spark, folder)
    years = sorted(int(p.name[5:]) for p in Path(folder, "years").glob("year=*"))
    x = ev.search(spark, folder, text=F.col("text"), terms=["week"], id="id", at_ms="ms", limit=3)
    assert {int(f.split("year=")[1].split("/")[0]) for f in x.inputFiles()} <= set(years) and x.count() == 3
    assert f"year = {years[0]}" not in x._jdf.queryExecution().toString() and f"= {years[0]})" not in x._jdf.queryExecution().toString()


def test_changed_and_missing_shards_show(spark, tmp_path):
    folder = str(tmp_path / "x")
    build(spark, folder)
    check = lambda: {r["year"]: r["same"] for r in ev.verified(spark, folder, ["id", "text"]).collect()}
    before = check()
    assert len(before) == 10 and all(before.values())
    first, second = sorted(before)[:2]
    shutil.rmtree(Path(folder, "years", f"year={first}"))
    part = spark.createDataFrame([(1, "e1", "other", 1)], "id int, who string, text string, ms long")
    part.write.mode("append").parquet(f"{folder}/years/year={second}")
    assert check() == before | {first: False, second: False}
