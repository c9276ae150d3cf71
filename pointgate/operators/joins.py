"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys that are broadcast at most.
BROADCAST_KEYS = 100_000


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join (inner or left) in which null equals null, with one copy of the keys."""
    names = {c: f"_key{i}" for i, c in enumerate(on)}
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def hot_keys(df: DataFrame, on: list[str], hot_rows: int) -> DataFrame | None:
    """(on…, _salts) of the keys with more than ``hot_rows`` rows, or None where there are none.

    One aggregation of ``df`` that the driver waits for.  Up to ``BROADCAST_KEYS`` keys come back as a
    broadcast table, more of them as a plan (at most rows / ``hot_rows`` keys can be hot).
    """
    n = df.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    hot = n.select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    rows = hot.limit(BROADCAST_KEYS + 1).collect()
    if not rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, hot.schema)) if len(rows) <= BROADCAST_KEYS else hot


def salted(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides and the join keys, with a salt where ``left`` has hot keys."""
    hot = hot_keys(left, on, hot_rows)
    if hot is None:
        return left, right, on
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("_salts")
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return a, b, [*on, "_salt"]


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], how: str = "inner", hot_rows: int = 1_000_000) -> DataFrame:
    """Equi-join (inner or left) in which the rows of hot keys of ``left`` spread over several tasks.

    The keys of ``left`` are counted first, so pass one that is cheap to read twice.  Without a hot key
    this is a plain join.  ``spread`` names columns of ``left`` whose hash picks the salt; ``right`` is
    repeated once for each salt of a hot key only.  Nulls in ``on`` match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"salted_join can't do {how}")
    a, b, keys = salted(left, right, on, spread, hot_rows)
    return a.join(b, keys, how).drop("_salt")
