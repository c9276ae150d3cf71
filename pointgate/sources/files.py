"""File sources and sinks with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointgate.session import shared_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header; every field has a declared type, bad ones become null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists") -> None:
    """CSV with a fixed order of columns; nulls are empty."""
    df.select(*columns).write.mode(mode).option("header", True).option("nullValue", "").csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, keys in the order of the columns."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def latest(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of the newest dated folder or file; ``pattern`` extracts its date from the path."""
    x = df.withColumn("_date", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
    return x.join(F.broadcast(x.agg(F.max("_date").alias("_date"))), "_date").drop("_date")


def write_index(df: DataFrame, path: str, *, shard: str, order: list[str]) -> None:
    """Shards by a column, sorted inside: one shuffle, then local sorts."""
    df.repartition(shard).sortWithinPartitions(shard, *order).write.mode("errorifexists").partitionBy(shard).parquet(path)


def manifest(df: DataFrame, *, by: str, digest: list[str]) -> DataFrame:
    """(by, rows, digest): counts and an order-free digest of every group."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*digest)).alias("digest"))


def replace_atomically(df: DataFrame, path: str) -> None:
    """Write a Parquet table beside ``path`` and put it there by a rename.

    Readers see the old table or the new one as a whole: the old one is renamed away first, the new
    one renamed in, and a write that fails leaves the old one alone.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(fresh)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
    at = lambda p: hadoop.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
    had = fs.exists(at(path)) and fs.rename(at(path), at(old))
    if not fs.rename(at(fresh), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise OSError(f"can't put {fresh} to {path}")
    if had:
        fs.delete(at(old), True)
