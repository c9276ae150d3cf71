"""Problem 1 over the targeted corpus and the requested targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgate.llm import keys
from pointgate.llm.registry import query
from pointgate.llm.sampling import targeted_sample
from pointgate.session import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per trace with its family and round; traces without family are left out."""
    t = table(spark, sf_dir, "t11_targeted_v1").select("trace_id", keys.category(F.col("family")).alias("family"), "round", "ingested_at", "row_id")
    one = t.where(F.col("trace_id").isNotNull()).groupBy("trace_id").agg(F.max_by(F.struct("family", "round"), F.struct("ingested_at", "row_id")).alias("x"))
    return one.select("trace_id", "x.family", "x.round").where(F.col("family").isNotNull())


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_targets").withColumn("family", keys.category(F.col("family")))


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return targeted_sample(
        records(spark, sf_dir), targets(spark, sf_dir), record="trace_id", category=["family", "round"], request="request_id", target="target_id"
    )


_RECORDS = f"""
WITH rec AS (
  SELECT trace_id, {keys.CATEGORY_SQL.format("arg_max(family, (ingested_at, row_id))")} AS family, arg_max(round, (ingested_at, row_id)) AS round
  FROM (SELECT * REPLACE (coalesce(family, '') AS family, coalesce(round, -1) AS round) FROM t11_targeted_v1) GROUP BY trace_id),
cnt AS (SELECT family, round, count(*) AS available FROM rec WHERE family IS NOT NULL GROUP BY 1, 2),
tgt AS (
  SELECT t.target_id, t.request_id, {keys.CATEGORY_SQL.format("t.family")} AS family, coalesce(t.round, -1) AS round, t.share_ppm, t.sample_size, t.min_rows,
    greatest(t.min_rows, (t.sample_size::BIGINT * t.share_ppm + 999999) // 1000000) AS needed
  FROM sample_targets t),
rep AS (
  SELECT tgt.*, coalesce(cnt.available, 0) AS available FROM tgt LEFT JOIN cnt ON cnt.family = tgt.family AND cnt.round = tgt.round),
line AS (
  SELECT *, sample_size::HUGEINT * share_ppm AS share, least(sample_size::HUGEINT * share_ppm, available::HUGEINT * 1000000) AS len,
    coalesce(sum(least(sample_size::HUGEINT * share_ppm, available::HUGEINT * 1000000))
      OVER (PARTITION BY request_id ORDER BY family NULLS FIRST, round, target_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT
      + ('0x' || substr(md5('0:start:' || request_id), 1, 8))::BIGINT % 1000000 AS pos,
    least(min_rows, available) AS floor
  FROM rep),
drew AS (
  SELECT *, (pos + len) // 1000000 - pos // 1000000 AS drawn, greatest(floor - ((pos + len) // 1000000 - pos // 1000000), 0) AS added FROM line),
debt AS (
  SELECT *, sum(added) OVER (PARTITION BY request_id) AS debt, CASE WHEN drawn > floor AND drawn * 1000000 > share THEN drawn * 1000000 - share END AS above FROM drew),
firsts AS (
  SELECT *, (above IS NOT NULL AND row_number() OVER (PARTITION BY request_id ORDER BY above DESC NULLS LAST, family NULLS FIRST, round, target_id) <= debt)::INT AS first FROM debt),
spare AS (SELECT *, CASE WHEN share > len THEN 0 ELSE greatest(drawn - floor - first, 0) END AS spare FROM firsts),
upto AS (
  SELECT *, least(debt - sum(first) OVER w, sum(spare) OVER w) AS rest, greatest(sum(spare) OVER w, 1) AS spares,
    sum(spare) OVER (PARTITION BY request_id ORDER BY family NULLS FIRST, round, target_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM spare WINDOW w AS (PARTITION BY request_id)),
plan AS (SELECT *, first + (upto * rest) // spares - ((upto - spare) * rest) // spares AS paid FROM upto)
"""

_SAMPLE = """
, ranked AS (
  SELECT trace_id, family, round, row_number() OVER (PARTITION BY family, round ORDER BY md5('0:' || trace_id), trace_id) AS rank FROM rec WHERE family IS NOT NULL),
placed AS (
  SELECT p.*, r.trace_id, r.rank, (pos + len * r.rank // available) // 1000000 - pos // 1000000 AS upto_here, (pos + len * (r.rank - 1) // available) // 1000000 - pos // 1000000 AS upto_prior
  FROM plan p JOIN ranked r ON r.family = p.family AND r.round = p.round)
SELECT request_id, target_id, trace_id, CASE WHEN upto_here > upto_prior THEN 'drawn' ELSE 'floor' END AS drawn_as FROM placed
WHERE (upto_here > upto_prior AND upto_here <= drawn - paid) OR (upto_here = upto_prior AND rank - upto_here <= added)
"""


@query("p1_found", _RECORDS + "SELECT target_id FROM rep WHERE available < needed")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the records cannot fill: the sample holds every record of the category, and these are fewer than needed."""
    return p1_report(spark, sf_dir).where((F.col("sampled") < F.col("needed")) & (F.col("sampled") == F.col("available"))).select("target_id")


@query("p1_report", _RECORDS + "SELECT target_id, request_id, needed, available, greatest(needed - available, 0) AS missing, CAST(drawn + added - paid AS BIGINT) AS sampled FROM plan")
def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with the records it needs, has and misses, and the records the sample holds for it."""
    sample, report = drawn(spark, sf_dir)
    got = sample.groupBy("target_id").agg(F.count("*").alias("sampled"))
    return report.join(got, "target_id", "left").select("target_id", "request_id", "needed", "available", "missing", F.coalesce("sampled", F.lit(0)).alias("sampled"))


@query("p1_sample", _RECORDS + _SAMPLE)
def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of every request."""
    return drawn(spark, sf_dir)[0]
