"""Ranks with a total order, strict-past frames and stratified selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgate.operators.joins import null_safe_join
from pointgate.session import cut


def unique_rank(by: list[str], order: list[Column | str]) -> Column:
    """1, 2, 3, … without shared ranks: ``order`` must end in a unique column."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def cum_before(value: Column, *, key: list[str], order: str) -> Column:
    """Sum over strictly earlier values of ``order`` (ties excluded), 0 if there are none."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))


def top_by(df: DataFrame, by: list[str], order: list[Column | str], k: int | Column) -> DataFrame:
    return df.withColumn("_rk", unique_rank(by, order)).where(F.col("_rk") <= k).drop("_rk")


def stratified_top(df: DataFrame, by: list[str], value: str, tie: str, fraction: float) -> DataFrame:
    """The first ``fraction`` of each stratum by value descending, its size rounded half up."""
    r = sliced_rank(df, by=by, value=value, tie=tie, name="_rk", size="_n")
    return r.where(F.col("_rk") <= F.floor(fraction * F.col("_n") + 0.5)).drop("_rk", "_n")


def whole_groups_until(df: DataFrame, *, stratum: list[str], group: str, size: str, key: Column, target: Column) -> DataFrame:
    """Groups taken whole in the order of ``key`` while the rows taken before are fewer than ``target``: adds ``taken``."""
    before = F.coalesce(F.sum(size).over(Window.partitionBy(*stratum).orderBy(key, group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("taken", before < target)


def _sliced(df: DataFrame, by: list[str], value: str, slice_rows: int, descending: bool) -> tuple[DataFrame, int]:
    """(df with ``_slice``, slices): rows of a group cut at approximate quantiles, about ``slice_rows`` to a slice.

    The quantiles only decide where the cuts lie.  ``df`` is cut first, so its sources are read once.
    """
    slices = max(1, -(-df.count() // slice_rows))
    if slices == 1:
        return df.withColumn("_slice", F.lit(0)), 1
    df = cut(df)
    step = max(1, round(slices**0.5))
    cuts = df.groupBy(*by).agg(F.percentile_approx(value, [i / slices for i in range(1, slices)], max(1000, 10 * slices)).alias("_cuts"))
    coarse = F.transform(F.sequence(F.lit(step), F.size("_cuts"), F.lit(step)), lambda i: F.element_at("_cuts", i))
    cuts = cuts.withColumn("_coarse", F.when(F.size("_cuts") >= step, coarse).otherwise(F.slice("_cuts", 1, 0)))
    x = null_safe_join(df, cuts, by, "left") if by else df.crossJoin(F.broadcast(cuts))
    # Cuts below the value, in two steps: whole strides, then within one.
    strides = F.size(F.filter("_coarse", lambda c: c < F.col(value)))
    x = x.withColumn("_strides", strides * step)
    below = F.col("_strides") + F.size(F.filter(F.slice("_cuts", F.col("_strides") + 1, F.lit(step)), lambda c: c < F.col(value)))
    place = F.when(F.col(value).isNull(), slices + 1).otherwise((slices - below) if descending else below)
    return x.withColumn("_slice", place).drop("_cuts", "_coarse", "_strides"), slices


def sliced_totals(
    df: DataFrame, *, by: list[str], value: str, tie: list[str | Column], totals: dict[str, Column], size: str | None = None, slice_rows: int = 500_000, descending: bool = True
) -> DataFrame:
    """Running sums ``totals`` within ``by``, by value (nulls last) and then ``tie``, without sorting a group in one task.

    A sum is that within the row's slice plus the sums of the slices before; ``F.lit(1)`` gives the
    rank.  ``size`` names a column for the rows of the whole group.  Null equals null in ``by``.
    ``value`` is a number; groups of few distinct values have as few slices, one for each value.
    """
    for i, (name, c) in enumerate(totals.items()):
        df = df.withColumn(f"_t{i}", c)
    x, slices = _sliced(df, by, value, slice_rows, descending)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    within = Window.partitionBy(*by, "_slice").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = {name: F.sum(f"_t{i}").over(within) for i, name in enumerate(totals)}
    if slices == 1:
        if size:
            x = x.withColumn(size, F.count("*").over(Window.partitionBy(*by)))
        return x.withColumns(run).drop("_slice", *[f"_t{i}" for i in range(len(totals))])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*by, "_slice").agg(F.count("*").alias("_n"), *[F.sum(f"_t{i}").alias(f"_s{i}") for i in range(len(totals))])
    base = base.select(*by, "_slice", F.sum("_n").over(Window.partitionBy(*by)).alias("_all"), *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(totals))])
    x = null_safe_join(x.withColumns(run), base, [*by, "_slice"])
    x = x.withColumns({name: F.col(name) + F.col(f"_b{i}") for i, name in enumerate(totals)})
    if size:
        x = x.withColumn(size, F.col("_all"))
    return x.drop("_slice", "_all", *[f"{k}{i}" for k in ("_t", "_b") for i in range(len(totals))])


def sliced_rank(df: DataFrame, *, by: list[str], value: str, tie: str | list[str | Column], name: str = "rank", slice_rows: int = 500_000, descending: bool = True, size: str | None = None) -> DataFrame:
    """``name`` = 1, 2, 3, … within ``by``, by value (nulls last) and then ``tie``: see ``sliced_totals``."""
    tie = [tie] if isinstance(tie, str) else tie
    return sliced_totals(df, by=by, value=value, tie=tie, totals={name: F.lit(1).cast("long")}, size=size, slice_rows=slice_rows, descending=descending)


def quantiles(df: DataFrame, *, by: list[str], value: str, at: dict[str, float], slice_rows: int = 500_000, interpolate: bool = True) -> DataFrame:
    """(by…, one column for each name of ``at``): exact quantiles of the values that are not null.

    Linear between neighbours, or the element ``floor(q * (n - 1))`` without interpolation.  The rank of
    every value is found in slices, so no group is gathered or sorted in one task.
    """
    x = df.where(F.col(value).isNotNull()).select(*by, value)
    r = sliced_rank(x, by=by, value=value, tie=[], name="_rank", size="_n", descending=False, slice_rows=slice_rows)
    out = []
    for name, q in at.items():
        place = q * (F.col("_n") - 1)
        low = F.max(F.when(F.col("_rank") == F.floor(place) + 1, F.col(value)))
        high = F.max(F.when(F.col("_rank") == F.ceil(place) + 1, F.col(value)))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part if interpolate else low).alias(name))
    return r.groupBy(*by).agg(*out)
