"""Splits that keep related records together: a persisted component table and deficit filling.

The component table holds a pointer (node, parent) for every node that isn't the smallest of its
component.  An update maps the ends of its edges to the roots they have in the table, contracts them,
and merges the roots: every root hooks to its smallest neighbour, pointer jumping shortens the chains,
the edges are mapped to the new roots, and loops and repetitions drop out, until no edge is left.  It
then appends the pointers of the roots and nodes that moved, and rewrites nothing: an update reads the
table to find the ends of its edges, and all else costs as much as the edges.  Pointers of several
updates form chains, no longer than the number of updates; ``compact`` makes them one.

The work of each round is joins and aggregations on node keys; no component is ever gathered in one
place, and nothing is sent to the driver but counts.  Every round ends in a checkpoint, so a lost
executor costs one round.
"""

from __future__ import annotations

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators.joins import salted_join
from pointgate.session import cut

QUARANTINE = "quarantine"


def _jump(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, parent) with parents of parents, until every parent is a root."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        parents = cut(parents.join(up, "parent", "left").select("node", F.coalesce("_up", "parent").alias("parent"), F.col("_up").isNotNull().alias("_moved")))
        if parents.where("_moved").limit(1).count() == 0:
            return parents.drop("_moved")
        parents = parents.drop("_moved")


def merge_map(edges: DataFrame) -> DataFrame:
    """(node, parent) of every node of ``edges`` (a, b) that isn't the smallest of its component."""
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done: DataFrame | None = None
    while e.limit(1).count():
        both = e.union(e.select("b", "a")).toDF("node", "other")
        hooks = both.groupBy("node").agg(F.min("other").alias("parent")).where(F.col("parent") < F.col("node"))
        hooks = _jump(hooks)
        if done is None:
            done = hooks
        else:
            # Nodes that hooked in an earlier round follow their root; hot roots are salted.
            new = hooks.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
            done = cut(salted_join(done, new, ["parent"], ["node"], "left").select("node", F.coalesce("_up", "parent").alias("parent")).union(hooks))
        for side in ("a", "b"):
            new = hooks.select(F.col("node").alias(side), F.col("parent").alias("_root"))
            other = "b" if side == "a" else "a"
            e = salted_join(e, new, [side], [other], "left").select(F.coalesce("_root", side).alias(side), other)
        e = cut(e.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if done is None:
        done = e.select(F.col("a").alias("node"), F.col("b").alias("parent"))
    return done


class Components:
    """The component table persisted below ``folder``, one folder for each update."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> int:
        """Number of updates so far."""
        try:
            return self.spark.read.parquet(self.folder).agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def pointers(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}").select("node", "parent")

    def _write(self, pointers: DataFrame, version: int) -> None:
        pointers.select("node", "parent").write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def resolve(self, nodes: DataFrame, upto: int | None = None) -> DataFrame:
        """(node, component) of ``nodes`` (node; null ones are left out) after the first ``upto`` updates.

        A node that no update has named is a component of its own.
        """
        out = nodes.select("node").where(F.col("node").isNotNull()).distinct().withColumn("component", F.col("node"))
        for v in range(1, (self.versions() if upto is None else upto) + 1):
            up = self.pointers(v).toDF("component", "_up")
            out = salted_join(cut(out), up, ["component"], ["node"], "left").select("node", F.coalesce("_up", "component").alias("component"))
        return out

    def update(self, edges: DataFrame) -> int:
        """Add ``edges`` (a, b) and give the number of updates so far.

        Edges with a null end are ignored, repeated ones count once.  Edges that join nothing new are
        no update.
        """
        version = self.versions() + 1
        e = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b").distinct())
        if version > 1:
            ends = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
            at = self.resolve(ends).where(F.col("node") != F.col("component"))
            at = cut(at)
            for side, other in (("a", "b"), ("b", "a")):
                e = salted_join(e, at.toDF(side, "_c"), [side], [other], "left").select(F.coalesce("_c", side).alias(side), other)
            e = e.select("a", "b")
        moved = merge_map(e)
        if moved.isEmpty():
            return version - 1
        self._write(moved, version)
        return version

    def compact(self) -> None:
        """Make all pointers lead to roots, as the first update of a table that has no others."""
        versions = self.versions()
        if versions < 2:
            return
        every = self.pointers(1)
        for v in range(2, versions + 1):
            every = every.union(self.pointers(v))
        roots = cut(self.resolve(every.select("node"), versions)).toDF("node", "parent")
        # Safe at every moment: pointers to roots agree with the chains.
        self._write(roots, 1)
        for v in range(2, versions + 1):
            self._write(roots.where("false"), v)


def fill_deficits(sizes: DataFrame, kept: DataFrame | None, shares: DataFrame, *, large: int = 200, slice_rows: int = 500_000) -> DataFrame:
    """(component, split) for the components of ``sizes`` (component, stratum, n).

    ``kept`` (component, split) keeps what it has; a component that it names with several splits
    is quarantined.  The others fill, within each stratum, what ``shares`` (split_name, share_ppm)
    lacks: components of at least 1/``large`` of the stratum (so at most ``large`` of them) go one
    after the other to the split with the largest deficit; the rest stand in random order on a line
    that is cut by the deficits left, by a prefix sum over hash slices of about ``slice_rows`` components.  A split so
    misses its share by at most one small component.  A component lies in the stratum in which it
    has most rows.
    """
    best = Window.partitionBy("component").orderBy(F.col("n").desc(), F.col("stratum").asc_nulls_last())
    s = sizes.select("component", "stratum", "n", F.sum("n").over(Window.partitionBy("component")).alias("rows"), F.row_number().over(best).alias("_i"))
    s = s.where("_i = 1").select("component", F.coalesce("stratum", F.lit("")).alias("stratum"), "rows")
    if kept is not None:
        k = kept.groupBy("component").agg(F.when(F.count_distinct("split") == 1, F.min("split")).otherwise(F.lit(QUARANTINE)).alias("split"))
        s = s.join(k, "component", "left")
    else:
        s = s.withColumn("split", F.lit(None).cast("string"))
    s = cut(s)
    total = s.groupBy("stratum").agg(F.sum("rows").alias("total"))
    want = shares.groupBy(F.col("split_name").alias("split")).agg(F.sum("share_ppm").alias("ppm"))
    have = s.where(F.col("split").isNotNull()).groupBy("stratum", "split").agg(F.sum("rows").alias("have"))
    deficit = total.crossJoin(F.broadcast(want)).join(have, ["stratum", "split"], "left")
    deficit = deficit.select("stratum", "split", (F.col("total") * F.col("ppm") / 1e6 - F.coalesce("have", F.lit(0))).alias("lack"))
    lacks = deficit.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("split", "lack"))).alias("lacks"))

    free = salted_join(s.where(F.col("split").isNull()), total, ["stratum"], ["component"]).drop("split")
    big = free.where(F.col("rows") * large >= F.col("total"))

    def place(key: tuple, rows: pd.DataFrame, open_: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = {x["split"]: x["lack"] for x in open_["lacks"].iloc[0]} if len(open_) else {}
        for c, n in rows.sort_values(["rows", "component"], ascending=[False, True])[["component", "rows"]].itertuples(index=False):
            to = max(left, key=lambda x: (left[x], x))
            left[to] -= n
            out.append((c, to, n))
        return pd.DataFrame(out, columns=["component", "split", "rows"]).assign(stratum=key[0])

    lacks = lacks.select(F.col("stratum").alias("_stratum"), "lacks")
    placed = big.groupBy("stratum").cogroup(lacks.groupBy("_stratum")).applyInPandas(place, "component string, split string, rows long, stratum string")
    placed = cut(placed)
    more = placed.groupBy("stratum", "split").agg(F.sum("rows").alias("_more"))
    left = deficit.join(more, ["stratum", "split"], "left").select("stratum", "split", F.greatest(F.col("lack") - F.coalesce("_more", F.lit(0)), F.lit(0.0)).alias("lack"))
    upto = Window.partitionBy("stratum").orderBy("split")
    cuts = left.select("stratum", "split", F.sum("lack").over(upto).alias("_hi"), F.sum("lack").over(Window.partitionBy("stratum")).alias("_all"))
    cuts = cuts.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("_hi", "split"))).alias("cuts"), F.max("_all").alias("_all"))

    rest = free.where(F.col("rows") * large < F.col("total")).withColumn("_u", F.md5(F.col("component").cast("binary")))
    slices = max(1, -(-s.count() // slice_rows))
    rest = rest.withColumn("_slice", F.floor(F.conv(F.substring("_u", 1, 8), 16, 10).cast("long") * slices / 2**32).cast("int"))
    before = Window.partitionBy("stratum").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = rest.groupBy("stratum", "_slice").agg(F.sum("rows").alias("_n")).select(
        "stratum", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy("stratum")).alias("_rest")
    )
    line = Window.partitionBy("stratum", "_slice").orderBy("_u", "component")
    rest = rest.join(base.join(cuts, "stratum"), ["stratum", "_slice"]).withColumn("_at", F.sum("rows").over(line) + F.col("_base") - F.col("rows") / 2)
    at = F.col("_at") / F.col("_rest") * F.col("_all")
    hit = F.filter("cuts", lambda x: at <= x["_hi"])
    rest = rest.select("component", F.coalesce(F.try_element_at(hit, F.lit(1)), F.element_at("cuts", -1))["split"].alias("split"))
    return s.where(F.col("split").isNotNull()).select("component", "split").union(placed.select("component", "split")).union(rest)
