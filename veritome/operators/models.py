"""Models on pyspark.ml and the column arithmetic around them (M1, M2, M4, M5, M9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["calibrate", "classifier", "cumulative_targets", "ordinal_fit", "ordinal_probs", "regressor"]


def classifier(features: Sequence[str], label: str, kind: str = "logistic", **params) -> Pipeline:
    """Assembler, scaler and a classifier (M1): logistic, l1, elastic, svm, forest, tree or bayes."""
    models = {
        "logistic": lambda: LogisticRegression(**{"regParam": 0.01, **params}),
        "l1": lambda: LogisticRegression(**{"regParam": 0.01, "elasticNetParam": 1.0, **params}),
        "elastic": lambda: LogisticRegression(**{"regParam": 0.01, "elasticNetParam": 0.5, **params}),
        "svm": lambda: LinearSVC(**params),
        "forest": lambda: RandomForestClassifier(**{"seed": 7, **params}),
        "tree": lambda: DecisionTreeClassifier(**params),
        "bayes": lambda: NaiveBayes(**{"modelType": "gaussian", **params}),
    }
    model = models[kind]()
    model.setFeaturesCol("scaled").setLabelCol(label)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip"), StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True), model])


def regressor(features: Sequence[str], label: str, ridge: float = 0.0, lasso: float = 0.0) -> Pipeline:
    """Linear, ridge, lasso or elastic-net regression (M2)."""
    total = ridge + lasso
    lr = LinearRegression(featuresCol="raw_features", labelCol=label, regParam=total, elasticNetParam=lasso / total if total else 0.0)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw_features", handleInvalid="skip"), lr])


def calibrate(df: DataFrame, score: str, label: str):
    """An isotonic calibration of scores (M4)."""
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(df)


def cumulative_targets(label: Column, classes: int) -> list[Column]:
    """0/1 targets label > k of a cumulative ordinal model (M5)."""
    return [(label > k).cast("double") for k in range(classes - 1)]


def ordinal_fit(df: DataFrame, features: Sequence[str], label: str, classes: int) -> list:
    """One logistic model per threshold of an ordered label (M1)."""
    out = []
    for k, t in enumerate(cumulative_targets(F.col(label), classes)):
        out.append(classifier(features, f"above_{k}").fit(df.withColumn(f"above_{k}", t)))
    return out


def ordinal_probs(df: DataFrame, models: list) -> DataFrame:
    """``class_probs``: differences of the cumulative probabilities, made to fall with the threshold (M5, M9)."""
    for k, m in enumerate(models):
        df = m.transform(df).withColumn(f"_c{k}", F.get(vector_to_array("probability"), F.lit(1))).drop("raw_features", "scaled", "rawPrediction", "probability", "prediction")
    cum = [F.lit(1.0)]
    for k in range(len(models)):
        cum.append(F.least(cum[-1], F.col(f"_c{k}")))
    cum.append(F.lit(0.0))
    return df.withColumn("class_probs", F.array(*[cum[i] - cum[i + 1] for i in range(len(cum) - 1)])).drop(*[f"_c{k}" for k in range(len(models))])
