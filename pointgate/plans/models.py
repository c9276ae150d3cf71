"""Models over player seasons; numbers come from MLlib, tests hold invariants (no look-ahead, folds, bounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pointgate.operators import learning as ml
from pointgate.plans.registry import query
from pointgate.session import cut, table

FEATURES = ["ppr1", "games1", "rank1", "is_rb", "is_wr"]


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(season, player_id, features of the season before, y = among the first 24)."""
    s = table(spark, sf_dir, "season_points").groupBy("season", "player_id", "position").agg(F.max("total_ppr").alias("ppr"), F.max("games").alias("games"), F.min("pos_season_rank_ppr").alias("rank"))
    before = s.select((F.col("season") + 1).alias("season"), "player_id", F.col("ppr").alias("ppr1"), F.col("games").cast("double").alias("games1"), F.col("rank").cast("double").alias("rank1"))
    x = s.join(before, ["season", "player_id"], "left")
    flags = [(F.col("position") == p).cast("double").alias(f"is_{p.lower()}") for p in ("RB", "WR")]
    return x.select("season", "player_id", "ppr1", "games1", "rank1", *flags, (F.col("rank") <= 24).cast("double").alias("y"))


@query("walk_forward_gbt")
def walk_forward_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated boosted trees for every season, each learned and calibrated on the seasons before it only."""
    x = cut(frame(spark, sf_dir))
    return ml.calibrated_walk_forward("gbt", x, period="season", features=FEATURES, label="y").select("season", "player_id", "y", "p")


@query("perm_importance")
def perm_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much the Brier score of the later half of the seasons worsens when a feature is shuffled."""
    x = cut(frame(spark, sf_dir))
    seasons = sorted(r[0] for r in x.select("season").distinct().collect())
    split = seasons[len(seasons) // 2]
    model = ml.fit("forest", x.where(F.col("season") < split), FEATURES, "y")
    test = x.where(F.col("season") >= split)
    score = F.avg((F.col("p") - F.col("y")) ** 2)
    out = ml.predict(model, test).agg(score.alias("brier")).select(F.lit("none").alias("feature"), "brier")
    for f in FEATURES:
        out = out.unionAll(ml.predict(model, ml.permuted(test, f, "player_id", f)).agg(score.alias("brier")).select(F.lit(f), "brier"))
    return out


@query("grouped_oof")
def grouped_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold logistic probabilities; a player lies in one fold only."""
    return out_of_fold(spark, sf_dir).select("season", "player_id", "fold", "y", "p")


@query("threshold_curve")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and accuracy of the out-of-fold probabilities at 19 thresholds."""
    return ml.threshold_curve(out_of_fold(spark, sf_dir), "y", [round(0.05 * k, 2) for k in range(1, 20)])


@query("forest_grid")
def forest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated forests of three depths and three sizes, with five thresholds and five bands of abstention, scored on the last season; the first by accuracy, then by rows answered, then the smallest.

    Learned before the last two seasons, calibrated on the one before the last.
    """
    x = cut(frame(spark, sf_dir))
    seasons = sorted(r[0] for r in x.select("season").distinct().collect())
    before, last = seasons[-2:]
    out = None
    for depth in (3, 5, 7):
        for trees in (10, 20, 40):
            model = ml.fit("forest", x.where(F.col("season") < before), FEATURES, "y", trees=trees, depth=depth)
            fix = ml.calibrator(ml.predict(model, x.where(F.col("season") == before)), "y")
            p = fix(ml.predict(model, x.where(F.col("season") == last))).select("p", "y", F.lit(depth).alias("depth"), F.lit(trees).alias("trees"))
            out = p if out is None else out.unionAll(p)
    many = lambda values: F.explode(F.array(*map(F.lit, values)))
    c = out.withColumn("threshold", many([0.3, 0.4, 0.5, 0.6, 0.7])).withColumn("band", many([0.0, 0.05, 0.1, 0.15, 0.2]))
    told = F.abs(F.col("p") - F.col("threshold")) >= F.col("band")
    right = (F.col("p") >= F.col("threshold")) == (F.col("y") == 1)
    g = c.groupBy("depth", "trees", "threshold", "band").agg(F.count_if(told).alias("answered"), F.round(F.try_divide(F.count_if(told & right), F.count_if(told)), 6).alias("accuracy"))
    order = [F.col("accuracy").desc_nulls_last(), F.col("answered").desc(), "depth", "trees", "threshold", "band"]
    return g.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # one row a cell of the grid


def out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = cut(frame(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("player_id"), F.lit(3)).cast("int")))
    out = None
    for k in range(3):
        p = ml.predict(ml.fit("logistic", x.where(F.col("fold") != k), FEATURES, "y"), x.where(F.col("fold") == k))
        out = p if out is None else out.unionByName(p)
    return out
