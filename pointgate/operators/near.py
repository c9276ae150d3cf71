"""Pairs of similar texts and sets, exact, without comparing all with all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointgate.operators.joins import salted_join
from pointgate.session import cut


def _segments(text: str, k: int) -> list[tuple[int, int]]:
    """(start, length) of ``k + 1`` segments of nearly the same length."""
    short, more = divmod(len(text), k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (i > k - more)
        out.append((at, n))
        at += n
    return out


def edit_pairs(df: DataFrame, *, by: list[str], id: str, text: str, every: int = 10) -> DataFrame:
    """(by…, a, b, text_a, text_b, distance): rows a < b of one group with at most one edit for each ``every`` characters of the longer text.

    ``id`` must be unique in ``df``; rows with nulls in ``by``, ``id`` or ``text`` pair with nothing.
    Of k + 1 segments of the shorter text one stands unchanged in any text within k edits, and near
    its place (Pass-Join), so an equi-join on segments finds every pair.
    """
    df = cut(df.select(*by, F.col(id).alias("_id"), F.col(text).alias("_t")).dropna())
    keyed = "_l int, _k int, _i int, _seg string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("_t").schema) + ", " + keyed

    def index(t: str) -> set[tuple]:
        l, out = len(t), set()
        for k in {n // every for n in range(l, 2 * l + 1) if n - l <= n // every}:
            out |= {(l, k, i, t[at : at + n]) for i, (at, n) in enumerate(_segments(t, k))}
        return out

    def probe(t: str) -> set[tuple]:
        k, out = len(t) // every, set()
        for l in range(len(t) - k, len(t) + 1):
            d = len(t) - l
            for i, (at, n) in enumerate(_segments(t[:l], k)):
                for s in range(max(0, at - i, at + d - (k - i)), min(len(t) - n, at + i, at + d + k - i) + 1):
                    out.add((l, k, i, t[s : s + n]))
        return out

    def emit(keys):  # noqa: ANN001, ANN202
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = f.assign(_x=[list(keys(t)) for t in f["_t"]]).drop(columns="_t").explode("_x", ignore_index=True)
                for j, c in enumerate(("_l", "_k", "_i", "_seg")):
                    x[c] = [v[j] for v in x["_x"]]
                yield x.drop(columns="_x")

        hashed = F.xxhash64(*by, "_l", "_k", "_i", "_seg").alias("_key")
        return df.mapInPandas(run, schema).select(F.col("_id"), hashed)

    x, y = emit(index).withColumnRenamed("_id", "a"), emit(probe).withColumnRenamed("_id", "b")
    met = salted_join(cut(y), cut(x), ["_key"], ["b"], hot_rows=10_000).where(F.col("a") != F.col("b"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda s: df.select(*(by if s == "a" else []), *([] if s == "a" else [F.col(c).alias(f"_{c}") for c in by]), F.col("_id").alias(s), F.col("_t").alias(f"text_{s}"))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    z = met.join(side("a"), "a").join(side("b"), "b").where(same)
    most = F.floor(F.greatest(F.length("text_a"), F.length("text_b")) / every)
    z = z.withColumn("distance", F.levenshtein("text_a", "text_b")).where(F.col("distance") <= most)
    return z.select(*by, "a", "b", "text_a", "text_b", F.col("distance").cast("long").alias("distance"))


#: Bits of the slots that one task of ``shared_items`` counts.
RANGE_BITS = 20


def _slots(items: np.ndarray, bits: int) -> np.ndarray:
    """The slot of each 64-bit item among 2**bits."""
    x = items.astype(np.int64).view(np.uint64)
    return (((x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    """Small numbers below 2**32, packed: bytes of one weight side by side."""
    return zlib.compress(np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def shared_items(sets: DataFrame, items: str, *, bits: int, common: int, flush: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bitmap, slots, ranks): which of 2**bits slots two items or more fall into, and about the ``common`` fullest slots, with rank 1 for the emptiest of these.

    An item whose slot is not in the bitmap stands in one set only.  Tasks count their slots and send
    them on as differences, about a byte or two for each, so the items aren't shuffled.
    """
    inner = min(bits, RANGE_BITS)
    ranges = 1 << (bits - inner)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def packed() -> pd.DataFrame:
            slot, n = np.unique(np.concatenate(held), return_counts=True)
            of = slot >> inner
            first = np.flatnonzero(np.diff(of, prepend=-1))
            parts = zip(np.split(slot & ((1 << inner) - 1), first[1:]), np.split(n, first[1:]))
            blobs = [(_planes(np.diff(a, prepend=0)), _planes(b)) for a, b in parts]
            return pd.DataFrame({"range": of[first].astype("int32"), "slots": [b[0] for b in blobs], "counts": [b[1] for b in blobs]})

        held, size = [], 0
        for f in frames:
            if len(f):
                held.append(_slots(np.concatenate(f["_s"].tolist()), bits))
                size += len(held[-1])
            if size >= flush:
                yield packed()
                held, size = [], 0
        if size:
            yield packed()

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << inner, np.int64)
        for slots, counts in zip(f["slots"], f["counts"]):
            total[np.cumsum(_unplanes(slots))] += _unplanes(counts)
        top = np.argsort(-total, kind="stable")[: -(-4 * common // ranges)]
        top = top[total[top] > 3]
        r = int(f["range"].iloc[0])
        return pd.DataFrame({"range": [r], "bits": [np.packbits(total > 1).tobytes()], "slots": [top + (r << inner)], "counts": [total[top]]})

    counted = sets.select(F.col(items).alias("_s")).mapInPandas(count, "range int, slots binary, counts binary")
    rows = counted.groupBy("range").applyInPandas(merge, "range int, bits binary, slots array<long>, counts array<long>").toPandas()
    bitmap = np.zeros(-(-(1 << bits) // 8), np.uint8)
    for r, b in zip(rows["range"], rows["bits"]):
        bitmap[r * len(b) : (r + 1) * len(b)] = np.frombuffer(b, np.uint8)
    join = lambda c: np.concatenate([np.zeros(0, np.int64), *(np.asarray(x, np.int64) for x in rows[c])])
    slots, counts = join("slots"), join("counts")
    slots = slots[np.lexsort((slots, -counts))][:common][::-1]
    order = np.argsort(slots)
    return bitmap, slots[order], order + 1


def jaccard_pairs(df: DataFrame, *, id: str, items: str, least: float = 0.8, common: int = 65_536, filter_bits: int = 28, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(a, b, jaccard): ids a < b whose sets share at least ``least`` of their union.

    ``items`` holds distinct 64-bit numbers; rows of one ``id`` have the same set.  Sets that are so
    alike share one of the first n - ceil(least n) + 1 items of each in any order of items that both
    use (prefix filter).  The order puts items of one set only first, which pair nothing and need no
    row, and frequent ones last; it steers the cost and not the result.  ``df`` is read three times and
    must give the same each time: sets are shuffled only where they are in a candidate pair.
    """
    # No filter on the items, which would make them twice.
    sets = df.select(F.col(id).alias("_id"), F.coalesce(items, F.array().cast("array<bigint>")).alias("_s"))
    bits = max(10, min(filter_bits, (128 * sets.select("_id").count()).bit_length()))
    known = sets.sparkSession.sparkContext.broadcast(shared_items(sets, "_s", bits=bits, common=common))
    kind = sets.schema["_id"].dataType.simpleString()

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bitmap, keys, ranks = known.value
        for f in frames:
            if not len(f):
                continue
            size = f["_s"].map(len).to_numpy("int64")
            g, owner = np.concatenate(f["_s"].tolist()).astype(np.int64), np.repeat(np.arange(len(f)), size)
            slot = _slots(g, bits)
            shared = (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1
            at = np.minimum(np.searchsorted(keys, slot), max(len(keys) - 1, 0))
            late = np.where(keys[at] == slot, ranks[at], 0) if len(keys) else np.zeros(len(slot), np.int64)
            order = np.lexsort((g, late, shared, owner))
            place = np.arange(len(g)) - np.repeat(np.cumsum(size) - size, size)
            take = size - np.ceil(least * size - 1e-9).astype(np.int64) + 1
            pick = order[(place < np.repeat(take, size)) & (shared[order] > 0)]
            yield pd.DataFrame({"_id": f["_id"].to_numpy()[owner[pick]], "n": size[owner[pick]].astype("int32"), "g": g[pick]})

    p = cut(sets.mapInPandas(prefixes, f"_id {kind}, n int, g long").distinct())
    x, y = p.toDF("a", "n_a", "g"), p.toDF("b", "n_b", "g")
    enough = F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9
    met = cut(salted_join(x, y, ["g"], ["a"], hot_rows=10_000).where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct())
    ids = cut(met.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    few = ids.limit(broadcast_ids + 1).count() <= broadcast_ids
    sets = cut(sets.join(F.broadcast(ids) if few else ids, "_id", "left_semi").dropDuplicates(["_id"]))
    z = met.join(sets.toDF("a", "_sa"), "a").join(sets.toDF("b", "_sb"), "b")
    both = F.size(F.array_intersect("_sa", "_sb"))
    z = z.select("a", "b", (both / (F.size("_sa") + F.size("_sb") - both)).alias("jaccard"))
    return z.where(F.col("jaccard") >= least)
