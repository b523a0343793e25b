"""Boosting of MLlib trees: early stopping, trees with leaf values of their own, split counts.

MLlib grows the trees. What it lacks is here: stopping by the errors of validation rows with some patience, and leaf
values that suit a loss (quantiles of residuals, Newton steps of class scores), found by grouping rows by leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.functions.moments import let
from tidewater.sources.shared import drop_written, remove, shared_path, written

VALID = "_valid"


@dataclass
class Trees:
    """Settings of a tree ensemble.

    patience: boosting ends once so many rounds in a row brought no smaller error on the validation rows, and the
    rounds after the best one are cut off; None: all rounds are kept. Validation rows are those of whole groups, drawn
    by a seeded hash of the column `group`: about `valid_share` of the groups that a fit gets.
    """

    rounds: int = 40
    depth: int = 5
    rate: float = 0.1
    seed: int = 42
    share: float = 0.8
    patience: int | None = None
    valid_share: float = 0.2
    group: str | None = None


def stop_round(errors: Sequence[float], patience: int) -> int:
    """How many rounds to keep: up to the best error before the first `patience` rounds without a better one."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def with_validation(train: DataFrame, t: Trees) -> tuple[DataFrame, bool]:
    """train with the column _valid, and whether it is of use: without patience, or if either part is empty, no row is held out."""
    if t.patience is None:
        return train.withColumn(VALID, F.lit(False)), False
    if t.group is None:
        raise ValueError("early stopping needs the column that groups rows")
    drawn = F.pmod(F.xxhash64(F.lit(f"valid{t.seed}"), F.col(t.group)), F.lit(10_000)) < F.lit(t.valid_share * 10_000)
    marked = train.withColumn(VALID, F.coalesce(drawn, F.lit(False)))
    held, rest = marked.agg(F.count_if(VALID), F.count_if(~F.col(VALID))).first()
    if held and rest:
        return marked, True
    return train.withColumn(VALID, F.lit(False)), False


def truncated(model: GBTRegressionModel | GBTClassificationModel, rounds: int) -> GBTRegressionModel | GBTClassificationModel:
    """The model with its first trees alone. MLlib itself has no call for that."""
    if rounds >= model.getNumTrees:
        return model
    jvm, gateway = model._java_obj, _jvm()
    trees, weights = list(jvm.trees())[:rounds], list(jvm.treeWeights())[:rounds]
    kind = "classification.GBTClassificationModel" if isinstance(model, GBTClassificationModel) else "regression.GBTRegressionModel"
    made = _construct(gateway, kind, f"{model.uid}_{rounds}", trees, weights, [model.numFeatures] + ([2] if "classification" in kind else []))
    return model._copyValues(type(model)(made))


def _jvm():
    return SparkContext._active_spark_context._gateway


def _construct(gateway, kind: str, uid: str, trees: list, weights: list[float], numbers: list[int]):
    """An ensemble of Spark's from single trees."""
    ml = gateway.jvm.org.apache.spark.ml
    array = gateway.new_array(ml.regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, w) in enumerate(zip(trees, weights)):
        array[i], shares[i] = tree, float(w)
    package, name = kind.split(".")
    maker = getattr(getattr(ml, package), name)
    return maker(uid, array, shares, *numbers) if package == "classification" else maker(uid, array, shares)


def boosted(estimator, rows: DataFrame, t: Trees, loss: str | None = None):
    """A fitted MLlib booster, its error on the validation rows after every round, and how many rounds it keeps.

    rows: with the column _valid. All rounds are trained, as MLlib can't go on from a model; then errors of all rounds
    come from one pass over the validation rows.
    """
    if t.patience is None:
        return estimator.fit(rows), [], t.rounds
    model = estimator.fit(rows.filter(~F.col(VALID)))
    held = rows.filter(VALID)
    errors = model.evaluateEachIteration(held, loss) if loss else model.evaluateEachIteration(held)
    kept = stop_round(errors, t.patience)
    return truncated(model, kept), list(errors), kept


def split_counts(model, features: Sequence[str]) -> DataFrame:
    """feature, splits: how many inner nodes of all trees of a fitted model split by each feature (those that none uses: 0).

    Read from the table of nodes in the saved model, so that no tree is walked on the driver.
    """
    spark = SparkSession.active()
    path = shared_path(spark, "model")
    model.write().save(path)
    try:
        nodes = spark.read.parquet(f"{path}/data")
        node = "nodeData." if "nodeData" in nodes.columns else ""
        used = nodes.filter(F.col(f"{node}leftChild") >= 0).groupBy(F.col(f"{node}split.featureIndex").alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
        found = {r["_i"]: r["_n"] for r in used.collect()}  # a row for each feature
    finally:
        remove(spark, path)
    return spark.createDataFrame([(f, found.get(i, 0)) for i, f in enumerate(features)], "feature string, splits long")


@dataclass
class LeafEnsemble:
    """Trees whose leaves have values of their own: a score is start + rate * the sum of its leaves' values.

    One transform gives the leaves of all trees.
    """

    start: float
    rate: float
    trees: list[DecisionTreeRegressionModel] = field(default_factory=list)
    values: list[dict[int, float]] = field(default_factory=list)

    def add(self, tree: DecisionTreeRegressionModel, values: dict[int, float]) -> None:
        self.trees.append(tree)
        self.values.append(values)

    def cut(self, rounds: int) -> None:
        del self.trees[rounds:], self.values[rounds:]

    def model(self) -> GBTRegressionModel:
        trees = [t._java_obj for t in self.trees]
        return GBTRegressionModel(_construct(_jvm(), "regression.GBTRegressionModel", "leaf_ensemble", trees, [1.0] * len(trees), []))

    def score(self, df: DataFrame, out: str) -> DataFrame:
        """df, which has the vector _x, with the score; leaves that training never reached count 0."""
        if not self.trees:
            return df.withColumn(out, F.lit(self.start))
        placed = self.model().setFeaturesCol("_x").setPredictionCol("_t").setLeafCol("_leaves").transform(df)
        most = [max(v, default=0) + 1 for v in self.values]
        table = F.array(*[F.array(*[F.lit(float(v.get(i, 0.0))) for i in range(n)]) for v, n in zip(self.values, most)])
        steps = F.zip_with(vector_to_array("_leaves"), table, lambda leaf, v: F.coalesce(F.get(v, leaf.cast("int")), F.lit(0.0)))
        total = F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)
        return placed.withColumn(out, F.lit(self.start) + self.rate * total).drop("_t", "_leaves")


def leaf_value(values: dict[int, float], leaf: Column) -> Column:
    pairs = [F.lit(x) for k, v in sorted(values.items()) for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), leaf.cast("int")), F.lit(0.0)) if pairs else F.lit(0.0)


def _grown(label: str, leaf: str, t: Trees, seed: int, weight: str | None = None) -> DecisionTreeRegressor:
    made = DecisionTreeRegressor(featuresCol="_x", labelCol=label, predictionCol=f"{leaf}_t", leafCol=leaf, maxDepth=t.depth, seed=seed)
    return made.setWeightCol(weight) if weight else made


def pinball_boost(rows: DataFrame, start: float, alpha: float, t: Trees, leaf_accuracy: int = 10_000) -> tuple[LeafEnsemble, list[float]]:
    """Trees on the pinball loss's gradient whose leaves are quantiles of their residuals, and the errors of each round.

    rows: _x, _y and _valid. The running prediction is written every round, so that a round's jobs read one table and
    none computes earlier rounds again.
    """
    out, errors = LeafEnsemble(start, t.rate), []
    state, before = rows.select("_x", "_y", VALID).withColumn("_p", F.lit(start)), None
    for i in range(t.rounds):
        residual = F.col("_y") - F.col("_p")
        step = state.withColumn("_g", F.when(residual >= 0, F.lit(alpha)).otherwise(F.lit(alpha - 1)))
        tree = _grown("_g", "_leaf", t, t.seed + i).fit(step.filter(~F.col(VALID)))
        placed = tree.transform(state)
        found = placed.filter(~F.col(VALID)).groupBy("_leaf").agg(F.percentile_approx(residual, alpha, leaf_accuracy)).collect()  # at most 2^depth rows
        values = {int(r[0]): float(r[1]) for r in found}
        out.add(tree, values)
        state = written(placed.select("_x", "_y", VALID, (F.col("_p") + t.rate * leaf_value(values, F.col("_leaf"))).alias("_p")), "pinball")
        drop_written(before)
        before = state
        if t.patience is not None:
            late = F.col("_y") - F.col("_p")
            errors.append(state.filter(VALID).agg(F.avg(F.greatest(alpha * late, (alpha - 1) * late))).first()[0])
            if stop_round(errors, t.patience) + t.patience <= len(errors):
                break
    drop_written(before)
    if errors:
        out.cut(stop_round(errors, t.patience))
    return out, errors


def newton_leaves(placed: DataFrame, k: int, ridge: float) -> DataFrame:
    """class, leaf and value: the Newton step of each leaf of each class's tree, by one grouping of all rows.

    placed: arrays _g (gradients), _h (curvatures), and _leaf0 .. of the leaves; _w weights rows.
    """
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"_leaf{c}").cast("int").alias("leaf"), (F.col("_w") * F.get("_g", F.lit(c))).alias("g"), (F.col("_w") * F.get("_h", F.lit(c))).alias("h")) for c in range(k)])
    sums = placed.select(F.explode(parts).alias("x")).groupBy("x.class", "x.leaf").agg(F.sum("x.g").alias("g"), F.sum("x.h").alias("h"))
    return sums.select("class", "leaf", (F.col("g") / (F.col("h") + ridge)).alias("value"))


def softmax(scores: Column) -> Column:
    """Each power and their sum are computed once a row."""
    powers = lambda xs, top: F.transform(xs, lambda s: F.exp(s - top))
    shares = lambda ps, total: F.transform(ps, lambda p: p / total)
    summed = lambda ps: let(shares, ps, F.aggregate(ps, F.lit(0.0), lambda a, x: a + x))
    return let(lambda xs: let(summed, let(powers, xs, F.array_max(xs))), scores)


def softmax_boost(rows: DataFrame, shares: Sequence[float], t: Trees, ridge: float = 1.0, threads: int = 8) -> tuple[list[LeafEnsemble], list[float]]:
    """One tree for each class and round on softmax gradients, with Newton leaf values; and the log losses of each round.

    rows: _x, _y (class from 0), _w and _valid. shares: each class's share of the weight, whose logarithms are the
    first scores. A round grows the trees of all classes as concurrent jobs over one written table, in which each
    class's gradient is a column of its own: a fit reads its rows several times and computes nothing else. Curvatures
    count k / (k - 1) times, as is usual for softmax trees; ridge is added to a leaf's curvature.
    """
    k = len(shares)
    out = [LeafEnsemble(math.log(max(s, 1e-12)), t.rate) for s in shares]
    errors: list[float] = []
    columns = ["_x", "_y", "_w", VALID]
    scale = k / max(k - 1, 1)

    def kept(df: DataFrame, scores: Column) -> DataFrame:
        p = df.select(*columns, scores.alias("_f")).withColumn("_p", softmax(F.col("_f")))
        return written(p.select(*columns, "_f", "_p", *[((F.col("_y") == c).cast("double") - F.get("_p", F.lit(c))).alias(f"_g{c}") for c in range(k)]), "softmax")

    state = before = kept(rows, F.array(*[F.lit(e.start) for e in out]))
    with ThreadPoolExecutor(threads) as pool:
        for i in range(t.rounds):
            grow = state.filter(~F.col(VALID))
            trees = list(pool.map(lambda c: _grown(f"_g{c}", f"_leaf{c}", t, t.seed + i * k + c, "_w").fit(grow), range(k)))
            placed = state.withColumns({"_g": F.array(*[f"_g{c}" for c in range(k)]), "_h": F.transform("_p", lambda q: scale * q * (1 - q))})
            for tree in trees:
                placed = tree.transform(placed)
            found = newton_leaves(placed.filter(~F.col(VALID)), k, ridge).collect()  # a row for each leaf of k trees
            values: list[dict[int, float]] = [{} for _ in range(k)]
            for r in found:
                values[r["class"]][r["leaf"]] = float(r["value"])
            for c in range(k):
                out[c].add(trees[c], values[c])
            if t.patience is None and i == t.rounds - 1:
                break  # nothing reads the last scores
            moved = F.array(*[F.get("_f", F.lit(c)) + t.rate * leaf_value(values[c], F.col(f"_leaf{c}")) for c in range(k)])
            state = kept(placed, moved)
            drop_written(before)
            before = state
            if t.patience is not None:
                q = F.least(F.greatest(F.get("_p", F.col("_y").cast("int")), F.lit(1e-7)), F.lit(1 - 1e-7))
                errors.append(state.filter(VALID).agg(F.avg(-F.log(q))).first()[0])
                if stop_round(errors, t.patience) + t.patience <= len(errors):
                    break
    drop_written(before)
    if errors:
        for e in out:
            e.cut(stop_round(errors, t.patience))
    return out, errors
