"""Attributes as known at event time, by dyadic decomposition of validity intervals.

Time is a grid of whole numbers ``0 .. 2**levels - 1``; ``levels_of`` gives the levels that a grid
needs.  A half-open validity interval is
covered by at most ``2 * levels`` dyadic nodes ``(level, index)``; an instant lies in exactly one
node of each level.  Interval containment so becomes an equi-join on ``(key, level, index)``, which
hashes, spills and splits like any other equi-join; no range join and no per-key sort is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgate.operators.joins import salted


def levels_of(moments: int) -> int:
    """Levels of a grid of so many moments."""
    return max(1, (max(moments, 1) - 1).bit_length())


def cover(start: Column, end: Column, levels: int) -> Column:
    """Dyadic nodes that tile ``[start, end)``: array of (level, index)."""

    def at(level: Column) -> Column:
        low = F.expr("0L") + F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)
        high = F.call_function("shiftright", end, level)
        left = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("node")))
        right = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("node")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def enclosing(time: Column, levels: int) -> Column:
    """The node of each level that holds an instant: array of (level, index)."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(levels)),
        lambda level: F.struct(level.alias("level"), F.call_function("shiftright", time, level).alias("node")),
    )


def supersede(facts: DataFrame, key: str, since: str, precedence: list[str], end: int) -> DataFrame:
    """Cut open-ended facts ``[since, end)`` where a fact of higher precedence takes over.

    Of the facts of a key that start at one grid point only the first in precedence can ever be
    valid, so they are reduced first (map-side); the window then holds at most one row for each
    grid point of a key, however hot the key is.  Facts that never win are dropped.
    """
    rest = [c for c in facts.columns if c not in (key, since)]
    best = facts.groupBy(key, since).agg(F.max_by(F.struct(*rest), F.struct(*precedence)).alias("_f")).select(key, since, "_f.*")
    above = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in precedence]).rowsBetween(Window.unboundedPreceding, -1)
    until = F.coalesce(F.min(since).over(above), F.lit(end).cast("long"))
    return best.withColumn("_until", until).where(F.col(since) < F.col("_until"))


def as_known(
    events: DataFrame,
    facts: DataFrame,
    *,
    key: str,
    event_id: str,
    time: str,
    start: str,
    end: str,
    precedence: list[str],
    levels: int,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """For each event the one fact of its key whose half-open interval holds the event's time.

    ``events`` holds ``key``, ``event_id`` (unique) and ``time``; ``facts`` holds ``key``,
    ``start``, ``end`` and any payload.  The result has ``event_id`` and the payload columns of
    the fact that comes first by ``precedence`` (descending, nulls last).  Events with a null key
    or time, or without a fact, have no row; empty inputs give an empty result.  Payload columns
    may have any name, also one that the events have.  An event outside of the grid fails the query:
    its facts can't be told.

    Keys with more than ``hot_rows`` events are salted: their events spread over several join
    keys and their facts are repeated for each.  The events are read twice.
    """
    payload = [c for c in facts.columns if c not in (key, start, end)]
    at = F.col(time).cast("long")
    on_grid = F.when(at.between(0, 2**levels - 1), at).otherwise(F.raise_error(F.lit(f"an event lies outside of the grid of 2**{levels} moments")).cast("long"))
    e = events.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).alias("_key"), F.col(event_id).alias("_event"), on_grid.alias("_t"))
    f = facts.where(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        F.greatest(F.col(start).cast("long"), F.lit(0)).alias("_s"),
        F.least(F.coalesce(F.col(end).cast("long"), F.lit(2**levels)), F.lit(2**levels)).alias("_e"),
        F.struct(*payload).alias("_f"),
    )
    e, f, keys = salted(e, f.where(F.col("_s") < F.col("_e")), ["_key"], ["_event"], hot_rows)
    e = e.withColumn("_n", F.explode(enclosing(F.col("_t"), levels))).select(*keys, "_n.level", "_n.node", "_event", "_t")
    f = f.withColumn("_n", F.explode(cover(F.col("_s"), F.col("_e"), levels))).select(*keys, "_n.level", "_n.node", "_s", "_e", "_f")
    hits = e.join(f, [*keys, "level", "node"]).where((F.col("_s") <= F.col("_t")) & (F.col("_t") < F.col("_e")))
    first = F.struct(*[F.col(f"_f.{c}") for c in precedence])
    return (
        hits.groupBy("_event")
        .agg(F.max_by("_f", first).alias("_f"))
        .select(F.col("_event").alias(event_id), *[F.col(f"_f.{c}").alias(c) for c in payload if c != event_id])
    )
