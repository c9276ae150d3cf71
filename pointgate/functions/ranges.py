"""Written ranges of whole numbers, such as ``2015-2018,2021``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ranges(spec: str) -> list[tuple[int, int]]:
    """First and last of each part; blanks and empty parts don't count, a minus at the start is a sign."""
    out = []
    for part in spec.split(","):
        part = part.strip()
        if part:
            cut = part.find("-", 1)
            out.append((int(part), int(part)) if cut < 0 else (int(part[:cut]), int(part[cut + 1 :])))
    return out


def numbers(spec: str) -> list[int]:
    return [n for a, b in ranges(spec) for n in range(a, b + 1)]


def in_ranges(c: Column, spec: str) -> Column:
    """Whether a number lies in a written range; comparisons, so they reach the scan."""
    out = F.lit(False)
    for a, b in ranges(spec):
        out = out | (c == a if a == b else c.between(a, b))
    return out


def whole_numbers(spec: Column) -> Column:
    """The numbers of a column of written ranges, in order: array of long; parts that are no range are left out."""
    parts = F.transform(F.split(spec, ","), lambda p: F.trim(p))
    side = lambda p, g: F.regexp_extract(p, r"^(-?[0-9]+)(?:-(-?[0-9]+))?$", g).try_cast("long")
    pairs = F.filter(F.transform(parts, lambda p: F.struct(side(p, 1).alias("a"), F.coalesce(side(p, 2), side(p, 1)).alias("b"))), lambda x: x["a"] <= x["b"])
    return F.flatten(F.transform(pairs, lambda x: F.sequence(x["a"], x["b"])))
