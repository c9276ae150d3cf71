"""Structured Streaming over a folder of files: windows, deduplication, gates and counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointgate.sources.files import scratch


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")


def finish(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and read its result back.

    Append goes to a file sink.  In complete mode every batch holds the whole result and replaces
    the one before.
    """
    spark = df.sparkSession
    base = scratch(spark, "stream")
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        started = writer.format("parquet").start(f"{base}/out")
    else:
        started = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{base}/out")).start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def capped(df: DataFrame, key: str, order: list[str], cap: int) -> DataFrame:
    """Rows of a stream with their number within the key so far, and whether the cap still allows them."""
    schema = df.select(key, *order).withColumns({"used": F.lit(0).cast("long"), "allowed": F.lit(True)}).schema

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        f = pd.concat(list(frames)).sort_values(order)
        f = f.assign(used=range(used + 1, used + 1 + len(f)))
        state.update((used + len(f),))
        yield f.assign(allowed=f["used"] <= cap)

    return df.select(key, *order).groupBy(key).applyInPandasWithState(run, schema, "used long", "append", GroupStateTimeout.NoTimeout)
