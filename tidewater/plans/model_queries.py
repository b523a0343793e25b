"""Registered queries of the model layer. SQL can't express trained trees, so most give rows only; the stack has its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.ml import models
from tidewater.ml.boosting import Trees
from tidewater.operators import features, split
from tidewater.plans.queries import O, P, panel, sql
from tidewater.sources.shared import written

NAMES = ["order_lag1", "order_mean5", "pack_mean5", "timeslot", "robot_idle"]
SMALL = Trees(rounds=4, depth=3, rate=0.3)
STOPPING = Trees(rounds=4, depth=3, rate=0.3, patience=1, group="scenario_id")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Features, folds and labels, written once, as a fit reads them several times."""
    df = panel(spark, sf).select("ID", "scenario_id", "split", "target", "timeslot", "robot_idle", P.lag("order_inflow_15m").alias("order_lag1"), P.roll("order_inflow_15m", 5, "mean").alias("order_mean5"), P.roll("pack_utilization", 5, "mean").alias("pack_mean5"))
    y = features.labels(F.col("target"))
    return written(split.group_kfold(df, "scenario_id", 3).withColumns({"lt1": y["lt1"], "high50": y["high50"], "bin": features.digitise(F.col("target"), features.STABLE).cast("int")}), "matrix")


def _cross(spark, sf, fit, out="pred", test=True, splits=False) -> models.CrossFit:
    df = matrix(spark, sf)
    return models.cross_fit(df.filter("split = 'train'"), df.filter("split = 'test'") if test else None, fit, out=out, folds=3, splits=splits)


@query
def ml_oof_absolute(spark, sf):
    found = _cross(spark, sf, models.absolute_regressor(NAMES, "target", SMALL))
    return found.oof.select("ID", "pred").unionByName(found.test.select("ID", "pred"))


@query
def ml_oof_log_target(spark, sf):
    found = _cross(spark, sf, models.absolute_regressor(NAMES, "target", SMALL, log=True))
    return found.oof.select("ID", "pred").unionByName(found.test.select("ID", "pred"))


@query
def ml_gate_probability(spark, sf):
    return _cross(spark, sf, models.binary_classifier(NAMES, "high50", SMALL), "p", test=False).oof.select("ID", "p")


@query
def ml_bin_probabilities(spark, sf):
    classes = len(features.STABLE) - 1
    found = _cross(spark, sf, models.class_probabilities(NAMES, "bin", classes, Trees(rounds=2, depth=3, rate=0.3)), "p", test=False)
    return found.oof.select("ID", *[c.alias(n) for n, c in features.bin_probability_features(F.col("p"), features.STABLE).items()])


@query
def ml_quantile(spark, sf):
    found = _cross(spark, sf, models.quantile_regressor(NAMES, "target", 0.7, Trees(rounds=3, depth=3, rate=0.4)), test=False)
    return found.oof.select("ID", "pred")


@query
def ml_rounds(spark, sf):
    """Rounds that early stopping keeps in each fold."""
    return _cross(spark, sf, models.absolute_regressor(NAMES, "target", STOPPING), test=False).rounds


@query
def ml_importance(spark, sf):
    """Gain and split counts of each fold."""
    return _cross(spark, sf, models.absolute_regressor(NAMES, "target", SMALL), test=False, splits=True).importance


@query
def ml_stack(spark, sf):
    df = panel(spark, sf).select("ID", "target", "split", F.coalesce(P.lag("order_inflow_15m"), F.lit(0.0)).alias("a"), F.coalesce(P.roll("order_inflow_15m", 5, "mean"), F.lit(0.0)).alias("b"))
    model = models.ridge_stack(["a", "b"], "target")(df.filter("split = 'train'"))
    return model(df, "pred").select("ID", F.round("pred", 6).alias("pred"))


#: The closed form for two columns: standardised sums, the inverse of a 2 x 2 matrix and leverages for every penalty.
ORACLES["ml_stack"] = sql(
    "SELECT ID, round(greatest(my + w1 * (a - ma) / sa + w2 * (b - mb) / sb, 0), 6) AS pred FROM x, m, c",
    f"x AS (SELECT ID, split, target AS y, coalesce(lag(order_inflow_15m) OVER ({O}), 0) AS a, coalesce(avg(order_inflow_15m) OVER ({O} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS b FROM d)",
    "m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM x WHERE split = 'train')",
    "z AS (SELECT y - my AS y, n, (a - ma) / sa AS a, (b - mb) / sb AS b FROM x, m WHERE split = 'train')",
    "s AS (SELECT max(n) AS n, sum(a * b) AS g, sum(a * y) AS r1, sum(b * y) AS r2 FROM z)",
    "k AS (SELECT alpha, n + alpha AS t, g, (n + alpha) * (n + alpha) - g * g AS det, r1, r2 FROM s, (SELECT unnest([0.01e0, 0.1e0, 1e0, 10e0, 100e0]) AS alpha))",
    "w AS (SELECT alpha, t, g, det, (t * r1 - g * r2) / det AS w1, (t * r2 - g * r1) / det AS w2 FROM k)",
    "e AS (SELECT alpha, w1, w2, avg(pow((y - w1 * a - w2 * b) / (1 - 1 / n - (t * (a * a + b * b) - 2 * g * a * b) / det), 2)) AS error FROM z, w GROUP BY ALL)",
    "c AS (SELECT w1, w2 FROM e ORDER BY error, alpha LIMIT 1)",
)
