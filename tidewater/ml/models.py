"""Regressors, classifiers and stacks of the prediction pipeline, on MLlib.

Tree ensembles here are MLlib's, so figures differ from other gradient boosting libraries; losses, weights, targets
(log1p where asked for), folds and what is predicted are the same. A fitted model is a function from a frame to a frame
with one column more.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.nulls import SENTINEL, floor_at
from tidewater.ml import boosting
from tidewater.ml.boosting import VALID, Trees, with_validation
from tidewater.operators.features import aligned_probabilities, from_log, to_log
from tidewater.operators.quantiles import exact_quantiles

#: A fitted model: a function from a frame and a column name to the frame with predictions. It may carry importance
#: (gain by feature), forest (the MLlib model, for split counts), rounds (kept rounds), errors (on validation rows, by
#: round) and classes (the length of predicted arrays).
Fitted = Callable[[DataFrame, str], DataFrame]
Fit = Callable[[DataFrame], Fitted]


def assemble(df: DataFrame, features: Sequence[str], out: str = "_x", single: bool = False) -> DataFrame:
    """The feature vector; missing values are the sentinel. single: values are rounded to single precision."""
    value = lambda c: F.col(c).cast("float").cast("double") if single else F.col(c).cast("double")
    filled = df.select("*", *[F.coalesce(value(c), F.lit(SENTINEL)).alias(f"_f_{c}") for c in features])
    return VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol=out).transform(filled).drop(*[f"_f_{c}" for c in features])


def absolute_regressor(features: Sequence[str], target: str, t: Trees | None = None, log: bool = False, weight: str | None = None, single: bool = False) -> Fit:
    """Boosted trees for the absolute error; log: on log1p of the target, predictions inverted and not below 0.

    With t.patience boosting stops by the error on groups of the training rows, on the scale that is fitted.
    """
    t = t or Trees()

    def fit(train: DataFrame) -> Fitted:
        y = to_log(F.col(target)) if log else F.col(target)
        marked, early = with_validation(train.withColumn("_y", y.cast("double")), t)
        model = GBTRegressor(featuresCol="_x", labelCol="_y", lossType="absolute", maxIter=t.rounds, maxDepth=t.depth, stepSize=t.rate, seed=t.seed, subsamplingRate=t.share)
        if weight:
            model = model.setWeightCol(weight)
        found = boosting.boosted(model, assemble(marked, features, single=single), t if early else replace(t, patience=None), "absolute")
        return _regression(*found, features, log, single)

    return fit


def forest_regressor(features: Sequence[str], target: str, t: Trees | None = None, log: bool = False, single: bool = False) -> Fit:
    """A random forest; log: on log1p of the target, predictions inverted and not below 0. A forest has no rounds to stop."""
    t = t or Trees()

    def fit(train: DataFrame) -> Fitted:
        y = to_log(F.col(target)) if log else F.col(target)
        rows = assemble(train.withColumn("_y", y.cast("double")), features, single=single)
        model = RandomForestRegressor(featuresCol="_x", labelCol="_y", numTrees=t.rounds, maxDepth=t.depth, seed=t.seed).fit(rows)
        return _regression(model, [], t.rounds, features, log, single)

    return fit


def _carry(predict: Fitted, model, errors: list[float], rounds: int, features: Sequence[str]) -> Fitted:
    predict.importance = dict(zip(features, model.featureImportances.toArray().tolist()))
    predict.forest, predict.errors, predict.rounds = model, errors, rounds
    return predict


def _regression(model, errors: list[float], rounds: int, features: Sequence[str], log: bool, single: bool) -> Fitted:
    def predict(df: DataFrame, out: str) -> DataFrame:
        p = F.col("prediction")
        return model.transform(assemble(df, features, single=single)).withColumn(out, from_log(p) if log else floor_at(p)).drop("_x", "prediction")

    return _carry(predict, model, errors, rounds, features)


def balanced_weight(df: DataFrame, label: str, out: str = "_w") -> DataFrame:
    """Weights that give every class the same sum."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    k = counts.agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_all"))
    weights = counts.crossJoin(F.broadcast(k)).select(label, (F.col("_all") / (F.col("_k") * F.col("_n"))).alias(out))  # one row of totals
    placed = weights.withColumnRenamed(label, "_label")
    return df.join(F.broadcast(placed), F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")  # a row for each class


def binary_classifier(features: Sequence[str], label: str, t: Trees | None = None) -> Fit:
    """Probability of class 1 from boosted trees over balanced classes; constant if only one class is there.

    With t.patience boosting stops by the log loss on groups of the training rows.
    """
    t = t or Trees()

    def fit(train: DataFrame) -> Fitted:
        lowest, highest = train.agg(F.min(label), F.max(label)).first()
        if lowest == highest:
            return lambda df, out: df.withColumn(out, F.lit(float(highest or 0)))
        marked, early = with_validation(balanced_weight(train, label), t)
        if early and marked.filter(~F.col(VALID)).agg(F.countDistinct(label)).first()[0] < 2:
            marked, early = marked.withColumn(VALID, F.lit(False)), False
        estimator = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_w", maxIter=t.rounds, maxDepth=t.depth, stepSize=t.rate, seed=t.seed)
        model, errors, rounds = boosting.boosted(estimator, assemble(marked, features), t if early else replace(t, patience=None))

        def predict(df: DataFrame, out: str) -> DataFrame:
            got = model.transform(assemble(df, features))
            return got.withColumn(out, vector_to_array("probability")[1]).drop("_x", "prediction", "probability", "rawPrediction")

        return _carry(predict, model, errors, rounds, features)

    return fit


def class_probabilities(features: Sequence[str], label: str, classes: int, t: Trees | None = None, threads: int = 8) -> Fit:
    """An array of probabilities over all classes from 0 on, from one boosted tree a class and round; classes that training lacks have 0.

    Classes weigh the same. Rows without a label are left out. With t.patience boosting stops by the log loss on groups of the training rows.
    """
    t = t or Trees()

    def fit(train: DataFrame) -> Fitted:
        known = train.filter(F.col(label).isNotNull())
        marked, early = with_validation(balanced_weight(known, label), t)
        grown = marked.filter(~F.col(VALID))
        there = sorted((int(r[0]), float(r[1])) for r in grown.groupBy(label).agg(F.sum("_w")).collect())  # a row for each class
        if not there:
            return lambda df, out: df.withColumn(out, F.array(*[F.lit(0.0)] * classes))
        index = F.create_map(*[F.lit(v) for i, (c, _) in enumerate(there) for v in (c, i)])
        rows = assemble(marked.withColumn("_y", F.try_element_at(index, F.col(label).cast("int"))).filter(F.col("_y").isNotNull()), features)
        total = sum(w for _, w in there)
        own = t if early else replace(t, patience=None)
        ensembles, errors = boosting.softmax_boost(rows, [w / total for _, w in there], own, threads=threads)

        def predict(df: DataFrame, out: str) -> DataFrame:
            got = assemble(df, features)
            for i, e in enumerate(ensembles):
                got = e.score(got, f"_s{i}")
            p = boosting.softmax(F.array(*[F.col(f"_s{i}") for i in range(len(there))]))
            found = F.map_from_arrays(F.array(*[F.lit(c) for c, _ in there]), p)
            return got.withColumn(out, aligned_probabilities(found, classes)).drop("_x", *[f"_s{i}" for i in range(len(there))])

        predict.classes, predict.errors, predict.rounds = classes, errors, len(ensembles[0].trees)
        return predict

    return fit


def quantile_regressor(features: Sequence[str], target: str, alpha: float, t: Trees | None = None, leaf_accuracy: int = 10_000) -> Fit:
    """Boosting for the pinball loss: trees on its gradient, whose leaves are then set to the quantile of their residuals.

    With t.patience boosting stops by the pinball loss on groups of the training rows.
    """
    t = t or Trees(rounds=15, depth=4, rate=0.2)

    def fit(train: DataFrame) -> Fitted:
        marked, early = with_validation(train.withColumn("_y", F.col(target).cast("double")), t)
        rows = assemble(marked, features).select("_x", "_y", VALID)
        start = float(exact_quantiles(rows.filter(~F.col(VALID)), {"y": F.col("_y")}, {"q": ("y", alpha)}).first()[0])
        ensemble, errors = boosting.pinball_boost(rows, start, alpha, t if early else replace(t, patience=None), leaf_accuracy)

        def predict(df: DataFrame, out: str) -> DataFrame:
            got = ensemble.score(assemble(df, features), "_s")
            return got.withColumn(out, floor_at(F.col("_s"))).drop("_x", "_s")

        predict.errors, predict.rounds = errors, len(ensemble.trees)
        return predict

    return fit


@dataclass
class CrossFit:
    """oof: each training row's prediction by the model that didn't see its fold; test: the test rows' mean over all
    models; importance: fold, feature, importance (gain) and splits; rounds: fold, best_iteration and validation_error."""

    oof: DataFrame
    test: DataFrame | None
    importance: DataFrame
    rounds: DataFrame


def _mean(out: str, classes: int | None) -> Column:
    """The mean of a number, or of arrays place by place."""
    if classes is None:
        return F.avg(out)
    return F.array(*[F.coalesce(F.avg(F.get(out, F.lit(i))), F.lit(0.0)) for i in range(classes)])


def cross_fit(train: DataFrame, test: DataFrame | None, fit: Fit, fold: str = "fold", key: str = "ID", out: str = "pred", folds: int = 5, splits: bool = False) -> CrossFit:
    """A model for each fold. splits: also count splits by feature, from each saved model.

    train and test are read several times: pass written tables.
    """
    parts, tests, importance, rounds, classes = [], [], [], [], None
    for k in range(folds):
        model = fit(train.filter(F.col(fold) != k))
        classes = getattr(model, "classes", classes)
        parts.append(model(train.filter(F.col(fold) == k), out))
        if test is not None:
            tests.append(model(test, out).select(key, out))
        gains = getattr(model, "importance", {})
        forest = getattr(model, "forest", None)
        counts = {r.feature: r.splits for r in boosting.split_counts(forest, list(gains)).collect()} if splits and forest is not None else {}
        importance += [(k, n, float(v), counts.get(n)) for n, v in gains.items()]
        errors = getattr(model, "errors", [])
        kept = getattr(model, "rounds", None)
        rounds.append((k, kept, float(errors[kept - 1]) if errors else None))
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    mean = None
    if tests:
        mean = tests[0]
        for p in tests[1:]:
            mean = mean.unionByName(p)
        mean = mean.groupBy(key).agg(_mean(out, classes).alias(out))
    spark = train.sparkSession
    return CrossFit(
        oof, mean, spark.createDataFrame(importance, "fold int, feature string, importance double, splits long"),
        spark.createDataFrame(rounds, "fold int, best_iteration int, validation_error double"),
    )


def out_of_fold(train: DataFrame, test: DataFrame | None, fit: Fit, fold: str = "fold", key: str = "ID", out: str = "pred", folds: int = 5) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Out-of-fold predictions, mean test predictions and gains (fold, feature, importance) of cross_fit."""
    found = cross_fit(train, test, fit, fold, key, out, folds)
    return found.oof, found.test, found.importance.drop("splits")


def ridge_stack(columns: Sequence[str], target: str, alphas: Sequence[float] = (0.01, 0.1, 1.0, 10.0, 100.0)) -> Fit:
    """Standardised ridge regression over predictions; the penalty with the least leave-one-out squared error is used, of ties the first.

    Leaving a row out changes its residual to e / (1 - h), where h is its leverage. One pass gathers the products of
    all columns, whose eigenvectors the driver computes from a matrix of their number; a second one sums up the
    squared leave-one-out errors of every penalty. Rows with a missing value are left out; none at all is an error.
    """
    def fit(train: DataFrame) -> Fitted:
        n = len(columns)
        complete = train.select(*[F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate([*columns, target])]).dropna()
        xs = [*[F.col(f"_c{i}") for i in range(n)], F.lit(1.0), F.col(f"_c{n}")]
        pairs = [(i, j) for i in range(n + 2) for j in range(i, n + 2)]
        row = complete.agg(*[F.sum(xs[i] * xs[j]) for i, j in pairs]).first()
        if row[0] is None:
            raise ValueError("no rows without missing values")
        m = np.zeros((n + 2, n + 2))
        for (i, j), v in zip(pairs, row):
            m[i, j] = m[j, i] = v
        count, mean, level = m[n, n], m[:n, n] / m[n, n], m[n, n + 1] / m[n, n]
        var = np.maximum(np.diag(m)[:n] / count - mean**2, 0)
        scale = np.where(var > 1e-12 * np.maximum(mean**2, 1), np.sqrt(var), 1)
        gram = (m[:n, :n] - count * np.outer(mean, mean)) / np.outer(scale, scale)
        right = (m[:n, n + 1] - mean * m[n, n + 1]) / scale
        spread, vectors = np.linalg.eigh(gram)
        spread, turned = np.maximum(spread, 0), vectors.T @ right
        z = [(F.col(f"_c{i}") - float(mean[i])) / float(scale[i]) for i in range(n)]
        along = complete.select(F.col(f"_c{n}").alias("_y"), *[sum((float(v) * c for v, c in zip(vectors[:, k], z)), F.lit(0.0)).alias(f"_u{k}") for k in range(n)])
        u = [F.col(f"_u{k}") for k in range(n)]

        def left_out(alpha: float) -> Column:
            pred = sum((float(turned[k] / (spread[k] + alpha)) * u[k] for k in range(n)), F.lit(float(level)))
            leverage = sum((u[k] * u[k] / float(spread[k] + alpha) for k in range(n)), F.lit(float(1 / count)))
            return F.avg(F.pow(F.try_divide(F.col("_y") - pred, 1 - leverage), F.lit(2.0)))

        errors = [float("inf") if e is None else e for e in along.agg(*[left_out(a) for a in alphas]).first()]
        best = alphas[errors.index(min(errors))]
        w = vectors @ (turned / (spread + best)) / scale
        constant = float(level - w @ mean)

        def predict(df: DataFrame, out: str) -> DataFrame:
            total = F.lit(constant)
            for c, x in zip(columns, w):
                total = total + F.lit(float(x)) * F.col(c)
            return df.withColumn(out, floor_at(total))

        predict.alpha, predict.penalties = best, dict(zip(alphas, errors))
        return predict

    return fit


def linear_model(features: Sequence[str], target: str, penalty: float = 0.0) -> Fit:
    def fit(train: DataFrame) -> Fitted:
        rows = assemble(train, features)
        scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True).fit(rows)
        model = LinearRegression(featuresCol="_z", labelCol=target, regParam=penalty, elasticNetParam=0.0).fit(scaler.transform(rows))
        return lambda df, out: model.transform(scaler.transform(assemble(df, features))).withColumn(out, F.col("prediction")).drop("_x", "_z", "prediction")

    return fit


def top_features(importance: DataFrame, k: int) -> list[str]:
    ranked = importance.groupBy("feature").agg(F.avg("importance").alias("v")).orderBy(F.desc("v"), "feature").limit(k)
    return [r[0] for r in ranked.collect()]


def fallback_models(features: Sequence[str], target: str, group: str, rounds: int = 30, patience: int = 10) -> dict[str, Fit]:
    """Three differently built ensembles on log1p of the target for the weighted and stacked ensembles; boosting of the first stops early."""
    return {
        "lgbm": absolute_regressor(features, target, Trees(rounds=rounds, depth=5, rate=0.1, patience=patience, group=group), log=True, single=True),
        "xgb": absolute_regressor(features, target, Trees(rounds=rounds, depth=7, rate=0.07, seed=7, share=0.7), log=True, single=True),
        "cat": forest_regressor(features, target, Trees(rounds=rounds, depth=8, seed=11), log=True, single=True),
    }
