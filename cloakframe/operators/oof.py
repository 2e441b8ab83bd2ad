"""Scores out of fold: every row is scored by a model that has not seen its fold.

Rows are dealt to folds once, evenly by label, and stored.  For each fold a
pipeline of hashed term counts, inverse document frequencies and a logistic
regression is fitted on the other folds and scores the rows of this one; the
folds' scores together have one row for every row of the input.  Spark fits the
models in parallel over rows; the driver holds a coefficient for each of
`features` terms.

Rows with a null label are scored by the model of fold 0, and train none.
"""

from __future__ import annotations

import functools

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions import text as T
from cloakframe.operators import ranking
from cloakframe.sources import shared


def dealt(df: DataFrame, key: str, text: str, label: Column, folds: int = 5) -> DataFrame:
    """key, tokens, label (0 or 1), weight and fold, stored. Weights make both labels count alike."""
    rows = df.select(F.col(key).alias("key"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens"), label.cast("double").alias("label"))
    known = shared.stored(ranking.stratified_kfold(rows.where("label IS NOT NULL"), "label", F.col("key"), folds))
    n, ones = known.agg(F.count("*"), F.sum("label")).first()
    share = F.when(F.col("label") == 1, F.lit((ones or 0) / n)).otherwise(F.lit(1 - (ones or 0) / n)) if n else F.lit(0.5)
    rest = rows.where("label IS NULL").withColumn("fold", F.lit(0))
    return known.unionByName(rest).withColumn("weight", F.lit(0.5) / F.greatest(share, F.lit(1e-9)))


def fit(train: DataFrame, features: int, reg: float, max_iter: int) -> PipelineModel:
    steps = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=reg, maxIter=max_iter, tol=1e-8, standardization=False),
    ]
    return Pipeline(stages=steps).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select("key", "fold", F.col("label").cast("int").alias("label"), F.round(vector_to_array("probability")[1], 6).alias("score"))


def scores(df: DataFrame, key: str, text: str, label: Column, folds: int = 5, features: int = 1 << 16, reg: float = 0.01, max_iter: int = 25) -> DataFrame:
    """key, fold, label and score (probability of label 1) of every row; a fold whose training rows have one label gets the share of that."""
    rows = dealt(df, key, text, label, folds)
    parts = []
    for k in range(folds):
        train, held = rows.where((F.col("fold") != k) & F.col("label").isNotNull()), rows.where(F.col("fold") == k)
        least, most = train.agg(F.min("label"), F.max("label")).first()
        if least is None or least == most:
            parts.append(held.select("key", "fold", F.col("label").cast("int").alias("label"), F.lit(least).cast("double").alias("score")))
        else:
            parts.append(scored(fit(train, features, reg, max_iter), held))
    return functools.reduce(DataFrame.unionByName, parts)
