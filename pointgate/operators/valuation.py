"""Line-ups, replacement levels and value over replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lineup(df: DataFrame, *, by: list[str], position: str, order: list[Column | str], slots: dict[str, int], flex: list[str], flex_slots: int) -> DataFrame:
    """Rows that start: the first of each position in ``order``, then the best of the rest in ``flex``: adds ``role``."""
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col(position)), F.lit(0))
    ranked = df.withColumn("_rk", F.row_number().over(Window.partitionBy(*by, position).orderBy(*order)))
    starter = F.col("_rk") <= need
    open_ = ~starter & F.col(position).isin(flex)
    ranked = ranked.withColumn("_open", open_).withColumn("_fx", F.row_number().over(Window.partitionBy(*by, "_open").orderBy(*order)))
    role = F.when(starter, F.col(position)).when(F.col("_open") & (F.col("_fx") <= flex_slots), "FLEX")
    return ranked.withColumn("role", role).where(F.col("role").isNotNull()).drop("_rk", "_open", "_fx")


def replacement(df: DataFrame, *, by: list[str], position: str, value: str, id: str, slots: dict[str, int], flex: list[str], flex_slots: int) -> DataFrame:
    """(by…, position, replacement): the best value left after all starters and flex places are filled.

    Where nothing is left, the lowest value of the position's pool.
    """
    order = [F.col(value).desc(), F.col(id)]
    need = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in slots.items() for x in kv]), F.col(position)), F.lit(0))
    r = df.withColumn("_rk", F.row_number().over(Window.partitionBy(*by, position).orderBy(*order)))
    rest = (F.col("_rk") > need) & F.col(position).isin(flex)
    r = r.withColumn("_rest", rest).withColumn("_fx", F.row_number().over(Window.partitionBy(*by, "_rest").orderBy(*order)))
    left = (F.col("_rk") > need) & ~(F.col("_rest") & (F.col("_fx") <= flex_slots))
    return r.groupBy(*by, position).agg(F.coalesce(F.max(F.when(left, F.col(value))), F.min(value)).alias("replacement"))
