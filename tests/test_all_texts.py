"""Fingerprints and names of every script, against brute force."""

from __future__ import annotations

import hashlib

from pointgate.plans import load
from pointgate.plans.registry import QUERIES

load()
TEXTS = ["Plain text", "plain  TEXT", "Café au lait", "CAFÉ\tau\nlait ", "caf\u00e9\u00a0au lait", "日本 語", "日本\u3000語", "tab\there", "Kept ÉVAL", None, "", "Ünder\r\nline", "\x1cünder line"]
NAMES = ["José  Núñez", "PLAIN Name", None, "Łukasz\u00a0Øst", "日本", "Ty'Rell\tO’Brien"]


def plain(x: str) -> str:
    return " ".join(x.lower().split())


def test_every_text_is_deduplicated(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("kept  éval",), (None,)], "text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    groups: dict[str, list[int]] = {}
    for i, x in enumerate(TEXTS):
        if x is not None and plain(x) != "kept éval":
            groups.setdefault(hashlib.sha256(plain(x).encode()).hexdigest(), []).append(i)
    got = QUERIES["fingerprint_dedup_all"](spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["fp"], r["copies"]) for r in got} == {(min(v), k, len(v)) for k, v in groups.items()}
    assert len(got) == len(groups) == 6


def test_every_name_is_validated(spark, tmp_path):
    rows = [(i, n, f"Said {n.lower() if n and i % 2 == 0 else 'nobody'} here") for i, n in enumerate(NAMES)]
    spark.createDataFrame(rows, "doc_id long, player_name string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["person"], r["named"]) for r in QUERIES["staff_validation_all"](spark, str(tmp_path)).collect()}
    assert got == {(i, plain(n), plain(n) in t.lower()) for i, n, t in rows if n is not None} and len(got) == 5


def test_all_contain_the_ascii_ones(spark, sf_dir):
    for name in ("fingerprint_dedup", "staff_validation"):
        few, all_ = (QUERIES[n](spark, sf_dir) for n in (name, f"{name}_all"))
        keys = ["fp"] if name == "fingerprint_dedup" else few.columns
        assert few.select(keys).subtract(all_.select(keys)).count() == 0 and all_.count() > few.count()
