"""Problem 5 over the targeted corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgate.llm import keys
from pointgate.llm.registry import query
from pointgate.llm.splits import Components, fill_deficits
from pointgate.operators.joins import salted_join
from pointgate.session import cut, table
from pointgate.sources.files import scratch


def tied_rows(corpus: DataFrame) -> DataFrame:
    """(row_id, node, source, trace, family): the node of a row is its episode or card, else the row itself."""
    own = F.coalesce(keys.episode_key(F.col("trace_id")), F.concat(F.lit("row "), F.col("row_id")))
    source = F.coalesce(keys.trace_key(F.col("source_trace_id")), F.nullif(F.lower(F.trim("source_trace_id")), F.lit("")))
    return corpus.where(F.col("row_id").isNotNull()).select(
        "row_id", own.alias("node"), source.alias("source"), keys.trace_key(F.col("trace_id")).alias("trace"), keys.category(F.col("family")).alias("family")
    )


def ties(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from the node of a row to its own trace and to the trace that it names.

    Who names a trace and who has it need not be in one delivery: both tie to the trace.
    """
    trace = lambda c: F.concat(F.lit("trace "), c)
    named = F.array_compact(F.array(F.when(F.col("node") != F.concat(F.lit("row "), F.col("row_id")), trace("trace")), trace("source")))
    return rows.select(F.col("node").alias("a"), F.explode(named).alias("b")).distinct()


def late(corpus: DataFrame) -> DataFrame:
    """(row_id, late): whether a row came with the second delivery."""
    return corpus.select("row_id", F.coalesce(F.col("ingested_at") >= F.lit("2024-07-01").cast("timestamp_ntz"), F.lit(True)).alias("late"))


def components(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Components]:
    """The rows, and the component table over their nodes: built from the first delivery, extended by the second."""
    corpus = table(spark, sf_dir, "t11_targeted_v1")
    rows = cut(tied_rows(corpus).join(late(corpus), "row_id"))
    store = Components(spark, scratch(spark, "components"))
    for second in (False, True):
        store.update(ties(rows.where(F.col("late") == second)))
    return rows, store


def grouped(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return salted_join(rows, comps, ["node"], ["row_id"])


_SPLIT_SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_id, coalesce({keys.EPISODE_SQL.format("trace_id")}, 'row ' || row_id) AS node, {keys.TRACE_SQL.format("trace_id")} AS trace, {keys.TRACE_SQL.format("source_trace_id")} AS source
  FROM t11_targeted_v1),
e AS (
  SELECT DISTINCT s.node AS a, coalesce(o.node, 'trace ' || s.source) AS b
  FROM t s LEFT JOIN (SELECT DISTINCT trace, node FROM t) o ON o.trace = s.source WHERE s.source IS NOT NULL),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT node, node FROM t),
reach(a, b) AS (SELECT a, b FROM b UNION SELECT r.a, b.b FROM reach r JOIN b ON r.b = b.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
g AS (SELECT component, min(row_id) AS group_id, count(*) AS n FROM t JOIN comp USING (node) GROUP BY 1)
SELECT row_id, group_id FROM t JOIN comp USING (node) JOIN g USING (component) WHERE n > 1
"""


@query("p5_found", _SPLIT_SQL)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, group_id) of every row that is tied to another; the group is named by its smallest row."""
    rows, store = components(spark, sf_dir)
    comps = store.resolve(rows.select("node"))
    mine = cut(rows.groupBy("node").agg(F.min("row_id").alias("_first"), F.count("*").alias("_n")).join(comps, "node"))
    groups = mine.groupBy("component").agg(F.min("_first").alias("group_id"), F.sum("_n").alias("_rows")).where("_rows > 1")
    by_node = salted_join(mine.select("node", "component"), groups, ["component"], ["node"]).select("node", "group_id")
    return salted_join(rows.select("row_id", "node"), by_node, ["node"], ["row_id"]).select("row_id", "group_id")


@query("p5_splits")
def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, family, split): every row in one split, all rows of a component in the same."""
    rows, store = components(spark, sf_dir)
    rows = cut(grouped(rows, store.resolve(rows.select("node"))).select("row_id", "family", "component"))
    sizes = rows.groupBy("component", F.col("family").alias("stratum")).agg(F.count("*").alias("n"))
    splits = fill_deficits(sizes, None, table(spark, sf_dir, "split_shares"))
    return salted_join(rows, splits, ["component"], ["row_id"]).select("row_id", "family", "split")


@query("p5_incremental")
def p5_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the deliveries come: components of the first keep the splits they got then.

    New components fill the deficits, and components that the second delivery joins across splits are
    quarantined.
    """
    rows, store = components(spark, sf_dir)
    shares = table(spark, sf_dir, "split_shares")
    first = cut(store.resolve(rows.where(~F.col("late")).select("node"), 1))
    before = grouped(rows.where(~F.col("late")), first)
    sizes = before.groupBy("component", F.col("family").alias("stratum")).agg(F.count("*").alias("n"))
    kept = cut(fill_deficits(sizes, None, shares))

    now = cut(store.resolve(rows.select("node")))
    moved = salted_join(first, now.withColumnRenamed("component", "_now"), ["node"], ["component"])
    moved = salted_join(moved.select("component", "_now").distinct(), kept, ["component"], ["_now"]).select(F.col("_now").alias("component"), "split").distinct()
    after = cut(grouped(rows, now).select("row_id", "family", "component", "late"))
    sizes = after.groupBy("component", F.col("family").alias("stratum")).agg(F.count("*").alias("n"))
    splits = fill_deficits(sizes, moved, shares)
    return salted_join(after, splits, ["component"], ["row_id"]).select("row_id", "family", "late", "split")
