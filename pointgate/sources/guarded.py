"""Sources that refuse, skip or name what breaks their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def answers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(season, preset, question_id, p, seq) of answer files; season and preset stand in the path as ``pattern`` says."""
    x = spark.read.schema("question_id string, p double, seq int").option("recursiveFileLookup", True).json(folder)
    path = F.col("_metadata.file_path")
    return x.select(F.regexp_extract(path, pattern, 1).cast("int").alias("season"), F.regexp_extract(path, pattern, 2).alias("preset"), "question_id", "p", "seq")


def json_tree(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all JSON files below a folder with their ``_path``; lines that are no JSON are skipped."""
    s = T.StructType.fromDDL(schema).add("_broken", T.StringType())
    x = spark.read.schema(s).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(folder)
    return x.withColumn("_path", F.col("_metadata.file_path")).where(F.col("_broken").isNull()).drop("_broken")


def lines_digest(spark: SparkSession, folder: str) -> str:
    """A digest of the lines of a folder, whatever their order: of their sorted SHA-256 sums' exclusive or and their number."""
    part = lambda i: F.bit_xor(F.conv(F.substring(F.sha2("value", 256), 1 + 15 * i, 15), 16, 10).cast("long"))
    r = spark.read.text(folder).agg(F.count("*").alias("n"), *[part(i).alias(f"x{i}") for i in range(4)]).first()
    return ":".join(f"{v or 0:x}" for v in r)


def pinned_jsonl(spark: SparkSession, folder: str, schema: str, digest: str) -> DataFrame:
    """JSON lines, if they still have the digest; an error otherwise."""
    found = lines_digest(spark, folder)
    if found != digest:
        raise ValueError(f"{folder} has the digest {found}, not {digest}")
    return spark.read.schema(schema).json(folder)


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that a row breaks, else 'good'."""
    out = F.lit("good")
    for name, holds in reversed(rules):
        out = F.when(~holds, name).otherwise(out)
    return out


def unsealed(df: DataFrame, period: str, sealed: list[int]) -> DataFrame:
    """The rows, with an error as soon as one of a sealed period is read."""
    ok = F.when(~F.coalesce(F.col(period).isin(sealed), F.lit(False)), F.col(period)).otherwise(F.raise_error(F.concat(F.lit("sealed: "), F.col(period).cast("string"))).cast(df.schema[period].dataType))
    return df.withColumn(period, ok)
