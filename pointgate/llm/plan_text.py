"""Problems 6, 7 and 8 over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointgate.llm.encode import encode
from pointgate.llm.leaks import leaks
from pointgate.llm.registry import query
from pointgate.llm.visual import visual_forms, visual_pairs
from pointgate.session import table


@query("p6_ids")
def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ids) of every document by the public vocabulary byte_bpe_50k."""
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("p7_found")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) of every document that holds passages of an evaluation item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), document="doc_id", item="item_id").select("doc_id", "item_id")


@query("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with the number of documents that leak them, and the largest share of an item found in one."""
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), document="doc_id", item="item_id")
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("share").alias("largest_share"))


@query("p8_found")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id_a, doc_id_b) of documents that look the same but differ in characters."""
    return visual_pairs(table(spark, sf_dir, "documents"), document="doc_id")


@query("p8_forms")
def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, form): every text in its one form."""
    return visual_forms(table(spark, sf_dir, "documents"), document="doc_id").select("doc_id", "form")
