"""Point-in-time operators: gates, as-of, look-back, carry-forward and prior periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate(df: DataFrame, time: str, as_of: Column) -> DataFrame:
    """Rows strictly before ``as_of``; the boundary is excluded and a null time never passes."""
    return df.where(F.col(time) < as_of)


def asof_latest(left: DataFrame, right: DataFrame, *, key: list[str], time: str, right_time: str, payload: list[str]) -> DataFrame:
    """Each left row with the payload of the latest right row of its key strictly before its time.

    Both sides are interleaved in one sorted window per key, so nothing is multiplied; rows of
    equal time come with the left row first, which keeps the boundary out.  Left rows without a
    match keep nulls.  Null keys match nothing.
    """
    cols = left.columns
    a = left.select(*key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("_l"), F.lit(None).cast(right.select(F.struct(right_time, *payload)).schema[0].dataType).alias("_r"))
    r = F.struct(right_time, *payload)
    b = right.where(F.col(right_time).isNotNull()).select(*key, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(left.select(F.struct(*cols)).schema[0].dataType).alias("_l"), r.alias("_r"))
    w = Window.partitionBy(*key).orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.coalesce(*[F.col(k).isNull() for k in key], F.lit(False))
    x = a.unionByName(b).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 0")
    out = x.withColumn("_last", F.when(~known, F.col("_last")))
    return out.select("_l.*", F.col(f"_last.{right_time}").alias(f"asof_{right_time}"), *[F.col(f"_last.{c}").alias(f"asof_{c}") for c in payload])


def prior_period(df: DataFrame, *, key: list[str], period: str, values: list[str], steps: int = 1) -> DataFrame:
    """Values of the period exactly ``steps`` before; a gap gives nulls, unlike ``lag``."""
    before = df.select(*key, (F.col(period) + steps).alias(period), *[F.col(v).alias(f"prior{steps}_{v}") for v in values])
    return df.join(before, [*key, period], "left")


def carry_forward(value: Column, *, key: list[str], order: list[str]) -> Column:
    """The last non-null value up to and including the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
