"""Probability scores, calibration, lift and resampling intervals as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointgate.operators.ranking import sliced_totals

#: Fixed value: probabilities are clipped by this before the logarithm.
EPS = 1e-15


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-F.ln(F.when(y == 1, clipped).otherwise(1 - clipped)))


def decile(p: Column) -> Column:
    """0 … 9; the upper end belongs to the last bin."""
    return F.least(F.floor(p * 10), F.lit(9)).cast("int")


def reliability(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """(by…, bin, n, mean_p, freq) for the ten fixed bins; empty bins have n = 0 and nulls."""
    by = by or []
    got = df.groupBy(*by, decile(F.col(p)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("freq"))
    bins = df.sparkSession.range(10).select(F.col("id").cast("int").alias("bin"))
    grid = df.select(*by).distinct().crossJoin(F.broadcast(bins)) if by else bins
    return grid.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "freq")


def calibration_error(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error from a reliability table."""
    gap = F.abs(F.round("mean_p", 4) - F.round("freq", 4)) * F.col("n")
    return bins.groupBy(*(by or [])).agg((F.sum(gap) / F.sum("n")).alias("ece"))


def resample_draws(cells: DataFrame, reps: int, seed: str) -> DataFrame:
    """(rep, pos, pick): for every replicate as many picks with replacement as there are cells.

    A pick is a hash of seed, replicate and position, so replicates are the same on any cluster.
    The table grows with cells x replicates, never with rows.
    """
    n = cells.agg(F.count("*").alias("_n"))
    pos = cells.select(F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), F.col("pos")).crossJoin(F.broadcast(n))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("rep").cast("string"), F.col("pos").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return pos.select("rep", "pos", (draw % F.col("_n")).alias("pick"))


def index_percentile(values: Column, q: float) -> Column:
    """Element ``int(q * (n - 1))`` of the sorted values, without interpolation."""
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, (F.floor(q * (F.size(s) - 1)) + 1).cast("int"))


def average_precision(df: DataFrame, score: str, y: str, tie: str, by: list[str]) -> DataFrame:
    """Mean over the positives of hits / rank, ranked by score descending.

    Ranks and hits so far are running sums taken in slices, so no group is sorted in one task.
    """
    ranked = sliced_totals(df.select(*by, score, y, tie), by=by, value=score, tie=[tie], totals={"_rank": F.lit(1).cast("long"), "_hits": F.col(y).cast("long")})
    return ranked.where(F.col(y) == 1).groupBy(*by).agg(F.avg(F.col("_hits") / F.col("_rank")).alias("average_precision"))


def isotonic_decreasing(df: DataFrame, *, by: list[str], x: str, value: str, weight: str) -> DataFrame:
    """Weighted isotonic, non-increasing fit: ``min over a <= i of max over b >= i of mean(a..b)``.

    Equal to pooling adjacent violators, but made of a self-join over the knots of a curve; meant
    for curves of a bounded number of knots (bucket means), not for rows.
    """
    order = Window.partitionBy(*by).orderBy(x)
    k = df.select(*by, x, F.sum(F.col(value) * F.col(weight)).over(order).alias("_s"), F.sum(weight).over(order).alias("_w"), (F.col(value) * F.col(weight)).alias("_v"), F.col(weight).alias("_n"))
    a = k.select(*by, F.col(x).alias("_a"), (F.col("_s") - F.col("_v")).alias("_s0"), (F.col("_w") - F.col("_n")).alias("_w0"))
    b = k.select(*by, F.col(x).alias("_b"), "_s", "_w")
    i = k.select(*by, x)
    means = a.join(b, by).where(F.col("_a") <= F.col("_b")).withColumn("_mean", (F.col("_s") - F.col("_s0")) / (F.col("_w") - F.col("_w0")))
    low = i.join(means, by).where((F.col("_a") <= F.col(x)) & (F.col("_b") >= F.col(x)))
    return low.groupBy(*by, x, "_a").agg(F.max("_mean").alias("_m")).groupBy(*by, x).agg(F.min("_m").alias("fit"))
