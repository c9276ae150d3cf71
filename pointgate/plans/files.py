"""Source and sink round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.plans.registry import query
from pointgate.session import cut, table
from pointgate.sources import files as fs

_ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@query("source_roundtrip", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'csv' ELSE 'jsonl' END AS read_from FROM orders")
def source_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as dated CSV and JSON lines, read back with declared types, the newest date of each."""
    base = fs.scratch(spark, "roundtrip")
    o = table(spark, sf_dir, "orders")
    even, odd = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    fs.write_csv(even.where("o_orderkey % 10 = 0"), f"{base}/csv/2024-01-01", o.columns)
    fs.write_csv(even, f"{base}/csv/2024-02-01", o.columns)
    fs.write_jsonl(odd, f"{base}/jsonl/2024-02-01")
    a = fs.latest(fs.read_csv(spark, [f"{base}/csv/2024-01-01", f"{base}/csv/2024-02-01"], _ORDERS), r"/(\d{4}-\d\d-\d\d)/").withColumn("read_from", F.lit("csv"))
    b = fs.latest(fs.read_jsonl(spark, f"{base}/jsonl/*", _ORDERS), r"/(\d{4}-\d\d-\d\d)/").withColumn("read_from", F.lit("jsonl"))
    return a.unionByName(b).select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"), "o_orderpriority", "read_from")


@query(
    "nested_source",
    """WITH d AS (SELECT DISTINCT season, preset, player_id, adp FROM draftbench) SELECT season, preset, player_id, min(adp) AS adp FROM d WHERE adp IS NOT NULL GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY season, player_id ORDER BY CASE preset WHEN 'ppr' THEN 1 WHEN 'half_ppr' THEN 2 ELSE 3 END) = 1""",
)
def nested_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards as nested JSON documents, exploded; duplicate ids drop, and the first preset of a season wins."""
    base = fs.scratch(spark, "boards")
    d = table(spark, sf_dir, "draftbench").where(F.col("adp").isNotNull())
    fs.write_jsonl(d.groupBy("season", "preset").agg(F.collect_list(F.struct("player_id", "adp")).alias("players")), base)
    x = fs.read_jsonl(spark, base, "season int, preset string, players array<struct<player_id: string, adp: double>>").select("season", "preset", F.explode("players").alias("p"))
    x = x.groupBy("season", "preset", "p.player_id").agg(F.min("p.adp").alias("adp"))
    first = F.row_number().over(Window.partitionBy("season", "player_id").orderBy(F.when(F.col("preset") == "ppr", 1).when(F.col("preset") == "half_ppr", 2).otherwise(3)))
    return x.withColumn("r", first).where("r = 1").drop("r")


@query(
    "dual_schema_union",
    """WITH w AS (SELECT gsis_id, season, week, TRY_CAST(depth_team AS INTEGER) AS rank, depth_id, 'weekly' AS layout FROM depth_weekly), s AS (SELECT gsis_id, year(dt) AS season, CAST(NULL AS INTEGER) AS week, pos_rank AS rank, depth_id, 'snapshot' AS layout FROM depth_snapshot),
u AS (SELECT DISTINCT * FROM w UNION SELECT DISTINCT * FROM s) SELECT * FROM u""",
)
def dual_schema_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layouts of depth charts in one relation, repeated rows once."""
    w = table(spark, sf_dir, "depth_weekly").select("gsis_id", "season", "week", F.col("depth_team").try_cast("int").alias("rank"), "depth_id", F.lit("weekly").alias("layout"))
    s = table(spark, sf_dir, "depth_snapshot").select("gsis_id", F.year("dt").alias("season"), F.col("pos_rank").alias("rank"), "depth_id", F.lit("snapshot").alias("layout"))
    return w.unionByName(s, allowMissingColumns=True).distinct()


@query("sharded_index", "SELECT event_type, CAST(date_part('day', ts) AS INTEGER) AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE date_part('day', ts) BETWEEN 5 AND 9 GROUP BY 1, 2")
def sharded_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in shards by day, sorted inside; the query reads only the shards that it needs."""
    base = fs.scratch(spark, "index")
    fs.write_index(table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts")), base, shard="day", order=["ts", "event_id"])
    x = spark.read.parquet(base).where(F.col("day").between(5, 9))
    return x.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("manifest_counts", "SELECT source, count(*) AS rows FROM documents GROUP BY 1")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fs.manifest(table(spark, sf_dir, "documents"), by="source", digest=["doc_id", "text"]).select("source", "rows")


@query("cache_and_resume", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def cache_and_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work in two runs: the second skips the keys that the append-only log already has."""
    log = fs.scratch(spark, "log")
    work = cut(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")))
    work.where("user_id % 3 = 0").write.mode("append").parquet(log)
    done = spark.read.parquet(log).select("user_id")
    work.join(done, "user_id", "left_anti").write.mode("append").parquet(log)
    return spark.read.parquet(log)


@query("split_writer", "SELECT split, count(*) AS rows FROM (SELECT CASE WHEN row_number() OVER (ORDER BY sha256('3:' || item_id), item_id) <= floor(0.1::DOUBLE * (SELECT count(*) FROM eval_items)) THEN 'validation' ELSE 'train' END AS split FROM eval_items) GROUP BY 1")
def split_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and validation files by hash order; the table is one of a fixed 240 items."""
    base = fs.scratch(spark, "split")
    d = table(spark, sf_dir, "eval_items")
    r = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit("3:"), F.col("item_id")), 256), "item_id"))
    n = d.agg(F.floor(0.1 * F.count("*")).alias("k"))
    x = d.withColumn("r", r).crossJoin(F.broadcast(n)).select("item_id", "text", F.when(F.col("r") <= F.col("k"), "validation").otherwise("train").alias("split"))
    x.write.partitionBy("split").json(base)
    return spark.read.schema("item_id long, text string, split string").json(base).groupBy("split").agg(F.count("*").alias("rows"))
