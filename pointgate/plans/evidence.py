"""The document index: searches, entities, manifest and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgate.plans.registry import query
from pointgate.session import table
from pointgate.sources import evidence as ev
from pointgate.sources.files import scratch

GATE = 1_700_000_000_000
COLUMNS = ["doc_id", "player_id", "player_name", "position", "source", "title", "text", "published_ms"]


def index(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch(spark, "evidence")
    ev.write_evidence(table(spark, sf_dir, "documents").select(*COLUMNS), folder, id="doc_id", at_ms="published_ms", entity="player_id", digest=["doc_id", "text"])
    return folder


@query("evidence_search", f"SELECT doc_id, published_ms FROM documents WHERE contains(lower(concat_ws(' ', title, text, player_name)), 'given') AND contains(lower(concat_ws(' ', title, text, player_name)), 'week') AND published_ms < {GATE} ORDER BY published_ms DESC, doc_id LIMIT 40")
def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest documents before a gate that hold all terms, by shards from the newest year on until there are enough."""
    hay = F.concat_ws(" ", "title", "text", "player_name")
    return ev.search(spark, index(spark, sf_dir), text=hay, terms=["given", "week"], id="doc_id", at_ms="published_ms", limit=40, before_ms=GATE).select("doc_id", "published_ms")


@query("evidence_entity", "SELECT doc_id, published_ms FROM documents WHERE player_id = (SELECT player_id FROM documents WHERE player_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, player_id LIMIT 1)")
def evidence_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the player with most of them, from the player's bucket."""
    most = table(spark, sf_dir, "documents").where(F.col("player_id").isNotNull()).groupBy("player_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "player_id").first()
    return ev.of_entity(spark, index(spark, sf_dir), "player_id", most["player_id"] if most else "").select("doc_id", "published_ms")


@query("evidence_manifest", "SELECT year(make_timestamp(published_ms * 1000))::INTEGER AS year, count(*) AS rows, min(published_ms) AS first_ms, max(published_ms) AS last_ms FROM documents WHERE published_ms IS NOT NULL GROUP BY 1")
def evidence_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and range of every year's shard."""
    return ev.manifest(spark, index(spark, sf_dir)).select("year", "rows", "first_ms", "last_ms")


@query("evidence_verify", "SELECT year(make_timestamp(published_ms * 1000))::INTEGER AS year, count(*) AS rows, true AS same FROM documents WHERE published_ms IS NOT NULL GROUP BY 1")
def evidence_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards read again against the digests of the manifest."""
    return ev.verified(spark, index(spark, sf_dir), ["doc_id", "text"])
