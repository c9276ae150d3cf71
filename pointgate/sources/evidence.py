"""A point-in-time document index: shards by year, buckets by entity, and a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 32


def _bucket(entity) -> F.Column:  # noqa: ANN001
    return F.pmod(F.xxhash64(entity), F.lit(BUCKETS)).cast("int")


def write_evidence(documents: DataFrame, folder: str, *, id: str, at_ms: str, entity: str, digest: list[str]) -> None:
    """Write ``documents`` twice, by year and by bucket of the entity, and the manifest of the years.

    Rows without a time are in no year's shard; rows without an entity in no bucket.  Inside a file
    the newest come first, so that Parquet's statistics cut a search by time.
    """
    d = documents.withColumn("year", F.year(F.timestamp_millis(at_ms)))
    newest = [F.col(at_ms).desc(), F.col(id)]
    dated = d.where(F.col("year").isNotNull())
    dated.repartition("year", F.pmod(F.xxhash64(id), F.lit(8))).sortWithinPartitions("year", *newest).write.mode("errorifexists").partitionBy("year").parquet(f"{folder}/years")
    owned = d.where(F.col(entity).isNotNull()).drop("year").withColumn("bucket", _bucket(F.col(entity)))
    owned.repartition("bucket", entity).sortWithinPartitions("bucket", entity, *newest).write.mode("errorifexists").partitionBy("bucket").parquet(f"{folder}/entities")
    manifest = dated.groupBy("year").agg(F.count("*").alias("rows"), F.min(at_ms).alias("first_ms"), F.max(at_ms).alias("last_ms"), F.bit_xor(F.xxhash64(*digest)).alias("digest"))
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def verified(spark: SparkSession, folder: str, digest: list[str]) -> DataFrame:
    """(year, rows, same): whether the shards still are what the manifest says; a shard that is missing is not."""
    now = spark.read.parquet(f"{folder}/years").groupBy("year").agg(F.count("*").alias("_rows"), F.bit_xor(F.xxhash64(*digest)).alias("_digest"))
    same = (F.col("rows") == F.col("_rows")) & (F.col("digest") == F.col("_digest"))
    return manifest(spark, folder).join(now, "year", "left").select("year", "rows", F.coalesce(same, F.lit(False)).alias("same"))


def of_entity(spark: SparkSession, folder: str, entity: str, value: str) -> DataFrame:
    """The documents of an entity; reads its bucket only."""
    bucket = spark.range(1).select(_bucket(F.lit(value))).first()[0]
    return spark.read.parquet(f"{folder}/entities").where((F.col("bucket") == bucket) & (F.col(entity) == value)).drop("bucket")


def search(spark: SparkSession, folder: str, *, text: F.Column, terms: list[str], id: str, at_ms: str, limit: int, before_ms: int | None = None, where: F.Column | None = None) -> DataFrame:
    """The ``limit`` newest documents before ``before_ms`` whose text holds all terms.

    Shards are read from the newest year on, as the manifest lists them, until enough are found: older
    years are not touched.  The driver loops over years and sees counts only.
    """
    hay = F.lower(text)
    found, have = None, 0
    years = [r["year"] for r in manifest(spark, folder).orderBy(F.col("year").desc()).collect() if before_ms is None or r["first_ms"] < before_ms]
    every = spark.read.parquet(f"{folder}/years")
    for year in years:
        x = every.where(F.col("year") == year)
        for t in terms:
            x = x.where(F.contains(hay, F.lit(t.lower())))
        if before_ms is not None:
            x = x.where(F.col(at_ms) < before_ms)
        if where is not None:
            x = x.where(where)
        part = x.orderBy(F.col(at_ms).desc(), id).limit(limit - have)
        found = part if found is None else found.unionAll(part)
        have += part.count()
        if have >= limit:
            break
    return (found if found is not None else every.where("false")).drop("year")
