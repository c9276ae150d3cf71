"""Tie-broken, cohort and greedy matching."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgate.session import cut


def tiebreak_join(left: DataFrame, right: DataFrame, on: list[str], *, left_id: list[str], prefer: list[Column]) -> DataFrame:
    """Left join that keeps one right row for each left row: the first by ``prefer``."""
    w = Window.partitionBy(*left_id).orderBy(*prefer)
    return left.join(right, on, "left").withColumn("_rk", F.row_number().over(w)).where("_rk = 1").drop("_rk")


def unambiguous(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key stands once."""
    return df.join(df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n"), key)


def band_cohort(df: DataFrame, *, by: list[str], on: str, width: int, value: str) -> DataFrame:
    """Adds mean and count of ``value`` over rows of the same ``by`` with ``on`` at most ``width`` away.

    A range frame: one sort per group instead of a self-join of all pairs.
    """
    w = Window.partitionBy(*by).orderBy(on).rangeBetween(-width, width)
    return df.withColumn("cohort_mean", F.avg(value).over(w)).withColumn("cohort_n", F.count(value).over(w))


def tolerance_pairs(df: DataFrame, *, by: list[str], id: str, value: str, tolerance: float) -> DataFrame:
    """Candidate pairs (a < b by value, then id) of one group whose values differ by at most ``tolerance`` of the larger.

    Values fall into logarithmic bins of that width; a pair lies in one bin or in neighbours, so
    the join is an equi-join on group and bin.  Values must be positive.
    """
    step = -F.log1p(F.lit(-tolerance))
    binned = df.where(F.col(value) > 0).select(*by, F.col(id).alias("_id"), F.col(value).alias("_v"), F.floor(F.ln(value) / step).cast("long").alias("_bin"))
    low = binned.withColumn("_bin", F.explode(F.array(F.col("_bin"), F.col("_bin") + 1))).toDF(*by, "a", "value_a", "_bin")
    high = binned.toDF(*by, "b", "value_b", "_bin")
    near = (F.col("value_b") - F.col("value_a")) <= tolerance * F.col("value_b")
    ordered = (F.col("value_a") < F.col("value_b")) | ((F.col("value_a") == F.col("value_b")) & (F.col("a") < F.col("b")))
    return low.join(high, [*by, "_bin"]).where(ordered & near).drop("_bin")


def greedy_disjoint(pairs: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Of candidate pairs (a, b), taken in ``order``, those whose ends are both still free.

    The same pairs as a sequential pass takes, but in rounds: a pair is taken as soon as no pair
    before it shares an end, and pairs that share an end with a taken one drop out.  No group is
    held in one task; every round ends in a checkpoint.
    """
    columns = pairs.columns
    rest = cut(pairs.withColumn("_key", F.struct(*order, "a", "b")))
    taken = None
    while rest.limit(1).count():
        ends = rest.select(*by, F.explode(F.array("a", "b")).alias("_end"), "_key").groupBy(*by, "_end").agg(F.min("_key").alias("_min"))
        x = rest
        for side in ("a", "b"):
            x = x.join(ends.select(*by, F.col("_end").alias(side), F.col("_min").alias(f"_min_{side}")), [*by, side])
        now = cut(x.where((F.col("_key") == F.col("_min_a")) & (F.col("_key") == F.col("_min_b"))).select(*columns, "_key"))
        taken = now if taken is None else taken.unionByName(now)
        used = now.select(*by, F.explode(F.array("a", "b")).alias("_end"))
        for side in ("a", "b"):
            rest = rest.join(used.withColumnRenamed("_end", side), [*by, side], "left_anti")
        rest = cut(rest.select(*columns, "_key"))
    return (taken if taken is not None else rest).select(*columns)


def closest_first(left: list[tuple], right: list[tuple], within: float) -> list[tuple]:
    """(a, b, distance) of the pairs of (value, id) that a pass over all pairs by distance, then ids, takes while both ends are free.

    No pair but the next is held: once equal values are paired off, the closest pair that is left stands
    side by side in the order of values.  Values must differ by more than their distances are rounded.
    """
    values = sorted({v for v, _ in left} | {v for v, _ in right})
    at = {v: i for i, v in enumerate(values)}
    free: list[tuple[list, list]] = [([], []) for _ in values]
    for side, rows in enumerate((left, right)):
        for v, i in sorted(rows, reverse=True):  # the smallest id is the last
            free[at[v]][side].append(i)
    out = []
    for a, b in free:
        while a and b:
            out.append((a.pop(), b.pop(), 0.0))
    stand = [k for k, (a, b) in enumerate(free) if a or b]
    before, after = dict(zip(stand[1:], stand)), dict(zip(stand, stand[1:]))
    heap: list[tuple] = []

    def offer(x: int | None, y: int | None) -> None:
        if x is None or y is None or bool(free[x][0]) == bool(free[y][0]):
            return
        p, q = (x, y) if free[x][0] else (y, x)
        if (d := abs(values[p] - values[q])) <= within:
            heapq.heappush(heap, (d, free[p][0][-1], free[q][1][-1], p, q))

    for x, y in zip(stand, stand[1:]):
        offer(x, y)
    while heap:
        d, a, b, p, q = heapq.heappop(heap)
        x, y = min(p, q), max(p, q)
        if not free[p][0] or not free[q][1] or after.get(x) != y:
            continue
        if free[p][0][-1] != a or free[q][1][-1] != b:
            offer(x, y)
            continue
        out.append((free[p][0].pop(), free[q][1].pop(), d))
        for k in (x, y):
            if not any(free[k]):
                l, r = before.pop(k, None), after.pop(k, None)
                if l is not None:
                    after.pop(l)
                if r is not None:
                    before.pop(r)
                if l is not None and r is not None:
                    after[l], before[r] = r, l
                if k == x:
                    x = l
                else:
                    y = r
        offer(x, y)
    return out


def greedy_nearest(df: DataFrame, *, by: list[str], id: str, value: str, side: str, within: float) -> DataFrame:
    """(by…, a, b, distance): ``greedy_disjoint`` over all pairs of a group with ``side`` true and false and values at most ``within`` apart, by distance, a and b.

    ``id`` is unique in its group.  The pairs, which grow with the square of the rows, are never made: a
    group is held by one task as its ids and values, for a time of n log n.  Rows with nulls or without
    a finite value pair with nothing.
    """
    x = df.select(*by, F.col(id).alias("_id"), F.col(value).cast("double").alias("_v"), F.col(side).alias("_a")).dropna().where(F.abs("_v") < math.inf)
    schema = x.drop("_id", "_v", "_a").schema.add("a", x.schema["_id"].dataType).add("b", x.schema["_id"].dataType).add("distance", "double")

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        rows = lambda g: list(zip(g["_v"].tolist(), g["_id"].tolist()))
        return pd.DataFrame([(*key, *t) for t in closest_first(rows(f[f["_a"]]), rows(f[~f["_a"]]), within)], columns=schema.names)

    return x.groupBy(*by).applyInPandas(run, schema)
