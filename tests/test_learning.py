"""Models that see nothing of what comes later, and calibration."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pointgate.operators import learning as ml


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(7)
    rows = []
    for season in range(2015, 2020):
        for i in range(60):
            x, z = rng.gauss(0, 1), rng.choice([None, rng.random()])
            rows.append((season, f"p{i}", x, z, float(x + rng.gauss(0, 0.5) > 0)))
    return spark.createDataFrame(rows, "season int, player_id string, x double, z double, y double").cache()


def test_poisoned_future_changes_nothing(frame):
    run = lambda df: {(r["season"], r["player_id"]): r["p"] for r in ml.calibrated_walk_forward("logistic", df, period="season", features=["x", "z"], label="y").where("season <= 2018").collect()}
    poisoned = frame.withColumn("y", F.when(F.col("season") >= 2018, 1 - F.col("y")).otherwise(F.col("y"))).withColumn("x", F.when(F.col("season") == 2019, F.lit(99.0)).otherwise(F.col("x")))
    a, b = run(frame), run(poisoned)
    assert a.keys() == b.keys() and len(a) == 120 and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_predictions_learn(frame):
    got = ml.calibrated_walk_forward("logistic", frame, period="season", features=["x", "z"], label="y").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    assert got < 0.18


@pytest.mark.parametrize("isotonic_from", [10, 10_000])
def test_calibration_mends_the_scale(spark, isotonic_from):
    rng = random.Random(3)
    rows = [(p / 4, float(rng.random() < p)) for p in (rng.random() for _ in range(2000))]
    df = spark.createDataFrame(rows, "p double, y double")
    fixed = ml.calibrator(df, "y", isotonic_from)(df)
    before, after = (x.agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0] for x in (df, fixed))
    assert after < before - 0.05 and fixed.where("p < 0 or p > 1").count() == 0
    same = ml.calibrator(df.where("y = 1"), "y")(df)
    assert same.columns == ["p", "y"] and same.count() == 2000


def test_threshold_curve(spark):
    df = spark.createDataFrame([(0.2, 0.0), (0.4, 1.0), (0.6, 0.0), (0.8, 1.0)], "p double, y double")
    got = {r["threshold"]: tuple(r)[1:] for r in ml.threshold_curve(df, "y", [0.5, 0.9]).collect()}
    assert got == {0.5: (4, 2, 0.5, 0.5, 0.5), 0.9: (4, 0, None, 0.0, 0.5)}


@pytest.mark.parametrize("kind, features", [("gbt", ["x", "z"]), ("logistic", ["z"])])
def test_a_feature_without_values_in_the_first_period_is_left_unused(frame, kind, features):
    """Last season's numbers are missing in the first season, which alone teaches the model of the third."""
    df = frame.where("season <= 2017").withColumn("z", F.when(F.col("season") > 2015, F.col("z")))
    run = lambda df: {r["player_id"]: r["p"] for r in ml.calibrated_walk_forward(kind, df, period="season", features=features, label="y").collect()}
    got, other = run(df), run(df.withColumn("z", F.when(F.col("season") > 2015, F.lit(9.0))))
    assert len(got) == 60 and all(0 <= p <= 1 for p in got.values()) and all(abs(got[k] - other[k]) < 1e-9 for k in got)
