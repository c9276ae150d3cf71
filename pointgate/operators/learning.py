"""Walk-forward models on Spark MLlib: boosting, forests, grouped folds, permutation importance."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(kind: str, train: DataFrame, features: list[str], label: str, seed: int = 7, trees: int = 20, depth: int = 5):  # noqa: ANN201
    """A fitted pipeline: means for missing values, one vector, then the classifier.

    A feature without any value in ``train`` has no mean; it is zero in all rows, so the model can't use it.
    """
    models = {
        "gbt": lambda: GBTClassifier(labelCol=label, featuresCol="_x", maxIter=10, maxDepth=3, seed=seed),
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed),
        "logistic": lambda: LogisticRegression(labelCol=label, featuresCol="_x", maxIter=25, regParam=0.01),
    }
    filled = [f"_f_{c}" for c in features]
    values = train.agg(*[F.count(F.nanvl(F.col(c).cast("double"), F.lit(None))).alias(f"_f_{c}") for c in features]).first()
    known = [c for c in features if values[f"_f_{c}"]]
    zeros = [f"0D AS `_f_{c}`" for c in features if c not in known]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(zeros)} FROM __THIS__")] if zeros else []
    if known:
        stages.append(Imputer(inputCols=known, outputCols=[f"_f_{c}" for c in known]))
    stages += [VectorAssembler(inputCols=filled, outputCol="_x"), models[kind]()]
    return Pipeline(stages=stages).fit(train)


def predict(model, df: DataFrame) -> DataFrame:  # noqa: ANN001
    """The rows with the probability ``p`` of the label."""
    x = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return x.select(*df.columns, "p")


def calibrator(scored: DataFrame, label: str, isotonic_from: int = 500):  # noqa: ANN201
    """A function from (rows with ``p``) to rows with a calibrated ``p``, learned from scored rows.

    Isotonic with at least ``isotonic_from`` rows, else a sigmoid; rows of one outcome only leave ``p``.
    """
    seen = scored.agg(F.count("*").alias("n"), F.count_distinct(label).alias("k")).first()
    if seen["k"] < 2:
        return lambda df: df
    vector = VectorAssembler(inputCols=["p"], outputCol="_v")
    if seen["n"] >= isotonic_from:
        model = IsotonicRegression(featuresCol="_v", labelCol=label, predictionCol="_c").fit(vector.transform(scored))
        return lambda df: model.transform(vector.transform(df)).select(*[c for c in df.columns if c != "p"], F.col("_c").alias("p"))
    model = LogisticRegression(featuresCol="_v", labelCol=label, probabilityCol="_c", predictionCol="_y", rawPredictionCol="_r", maxIter=50).fit(vector.transform(scored))
    return lambda df: model.transform(vector.transform(df)).select(*[c for c in df.columns if c != "p"], vector_to_array("_c")[1].alias("p"))


def calibrated_walk_forward(kind: str, df: DataFrame, *, period: str, features: list[str], label: str, isotonic_from: int = 500) -> DataFrame:
    """Predictions for every period that has two or more before it.

    The model learns from all periods but the last before, the calibrator from that last one, so that
    nothing of the period itself or later is seen.
    """
    periods = sorted(r[0] for r in df.select(period).distinct().collect() if r[0] is not None)
    out = None
    for before, s in zip(periods[1:], periods[2:]):
        train = df.where(F.col(period) < before)
        if train.select(label).distinct().count() < 2:
            continue
        model = fit(kind, train, features, label)
        fix = calibrator(predict(model, df.where(F.col(period) == before)), label, isotonic_from)
        x = fix(predict(model, df.where(F.col(period) == s)))
        out = x if out is None else out.unionByName(x)
    return out if out is not None else df.where("false").withColumn("p", F.lit(0.0))


def threshold_curve(scored: DataFrame, label: str, thresholds: list[float]) -> DataFrame:
    """(threshold, n, taken, precision, recall, accuracy) from one pass over the scored rows."""
    x = scored.select("p", F.col(label).alias("_y"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    yes, hit = F.col("p") >= F.col("threshold"), F.col("_y") == 1
    g = x.groupBy("threshold").agg(F.count("*").alias("n"), F.count_if(yes).alias("taken"), F.count_if(yes & hit).alias("_tp"), F.count_if(hit).alias("_hits"), F.count_if(yes == hit).alias("_right"))
    return g.select("threshold", "n", "taken", F.try_divide("_tp", "taken").alias("precision"), F.try_divide("_tp", "_hits").alias("recall"), (F.col("_right") / F.col("n")).alias("accuracy"))


def walk_forward(kind: str, df: DataFrame, *, period: str, features: list[str], label: str, periods: list[int]) -> DataFrame:
    """Predictions for each period by a model of strictly earlier ones; periods without both outcomes before are left out."""
    out = None
    for s in periods:
        train = df.where(F.col(period) < s)
        if train.select(label).distinct().count() < 2:
            continue
        x = predict(fit(kind, train, features, label), df.where(F.col(period) == s))
        out = x if out is None else out.unionByName(x)
    return out if out is not None else df.where("false").withColumn("p", F.lit(0.0))


def permuted(df: DataFrame, column: str, key: str, seed: str) -> DataFrame:
    """The rows with one column shuffled among them by hash order, in slices that no task has to hold whole.

    A row takes the value of the next row of its slice in hash order; the slices are random too, so
    the values are exchanged among random rows.
    """
    from pyspark.sql import Window

    h = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))
    w = Window.partitionBy(F.substring(h, 1, 1)).orderBy(h)
    return df.withColumn(column, F.coalesce(F.lead(column).over(w), F.first(column).over(w)))
