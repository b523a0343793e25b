import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.ml import boosting, models
from tidewater.ml.boosting import Trees


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    x, z = r.uniform(0, 10, 600), r.uniform(0, 1, 600)
    rows = [(i, i % 3, f"g{i % 40}", float(a), float(b), float(3 * a + r.exponential(4)), int(min(2, a // 4))) for i, (a, b) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "ID int, fold int, g string, x double, z double, y double, k int").cache()


def noisy(spark, n=400):
    """A target that has nothing to do with the features, so that boosting soon makes validation errors worse."""
    r = np.random.default_rng(3)
    rows = [(i, f"g{i % 50}", float(r.uniform()), float(r.uniform()), float(r.normal()), int(r.uniform() < 0.5)) for i in range(n)]
    return spark.createDataFrame(rows, "ID int, g string, x double, z double, y double, k int").cache()


def test_stop_round():
    assert boosting.stop_round([5, 4, 3], 2) == 3
    assert boosting.stop_round([5, 4, 4, 4, 1], 2) == 2  # stops before it sees the 1
    assert boosting.stop_round([5, 4, 4, 3, 4], 2) == 4
    assert boosting.stop_round([1.0], 1) == 1


@pytest.mark.parametrize("kind", ["absolute", "log", "gate"])
def test_boosting_stops_before_the_last_round(spark, kind):
    df = noisy(spark).withColumn("y", F.abs("y"))
    t = Trees(rounds=12, depth=4, rate=0.5, patience=3, group="g")
    fit = models.binary_classifier(["x", "z"], "k", t) if kind == "gate" else models.absolute_regressor(["x", "z"], "y", t, log=kind == "log")
    model = fit(df)
    assert len(model.errors) == 12 and model.rounds == boosting.stop_round(model.errors, 3) < 12
    assert model.forest.getNumTrees == model.rounds
    held = boosting.with_validation(df, t)[0].filter("_valid")
    assert 0 < held.select("g").distinct().count() < 50 and held.select("g").distinct().join(boosting.with_validation(df, t)[0].filter("NOT _valid"), "g").count() == 0
    if kind == "absolute":  # the kept trees have the error that was measured after their round
        rows = models.assemble(held, ["x", "z"])
        got = model.forest.transform(rows).agg(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
        assert got == pytest.approx(model.errors[model.rounds - 1])


def test_early_stopping_needs_groups_and_rows_on_both_sides(spark, data):
    with pytest.raises(ValueError):
        models.absolute_regressor(["x"], "y", Trees(rounds=2, patience=1))(data)
    one = models.absolute_regressor(["x"], "y", Trees(rounds=2, depth=1, patience=1, group="g"))(data.filter("g = 'g1'"))
    assert one.errors == [] and one.rounds == 2  # a single group can't be on both sides


def test_rounds_of_each_fold_are_reported(data):
    fit = models.absolute_regressor(["x", "z"], "y", Trees(rounds=3, depth=2, rate=0.5, patience=2, group="g"))
    found = models.cross_fit(data, None, fit, folds=3)
    rows = found.rounds.orderBy("fold").collect()
    assert [r.fold for r in rows] == [0, 1, 2] and all(1 <= r.best_iteration <= 3 and r.validation_error > 0 for r in rows)


def test_split_counts_equal_a_walk_over_the_printed_trees(data):
    fit = models.absolute_regressor(["x", "z"], "y", Trees(rounds=4, depth=3, rate=0.5))
    model = fit(data)
    want = {"x": 0, "z": 0}
    for line in model.forest.toDebugString.splitlines():
        if found := re.match(r"\s*If \(feature (\d+) ", line):
            want["xz"[int(found[1])]] += 1
    assert {r.feature: r.splits for r in boosting.split_counts(model.forest, ["x", "z"]).collect()} == want and want["x"] > 0
    found = models.cross_fit(data, None, models.forest_regressor(["x", "z", "ID"], "y", Trees(rounds=2, depth=2)), folds=2, splits=True)
    assert found.importance.filter("splits IS NULL").count() == 0 and found.importance.count() == 6


def test_class_scores_equal_a_loop_over_fixed_trees(data):
    """Leaves of the grown trees are taken as they are; scores and leaf values are recomputed in NumPy."""
    rows = models.assemble(data.select("ID", F.col("k").alias("_y"), (1 + F.col("ID") % 2).cast("double").alias("_w"), F.lit(False).alias("_valid"), "x", "z"), ["x", "z"]).cache()
    shares, t = [0.5, 0.3, 0.2], Trees(rounds=3, depth=2, rate=0.4)
    ensembles, _ = boosting.softmax_boost(rows, shares, t)
    p = rows.select("ID", "_y", "_w").orderBy("ID").toPandas()
    y, w = np.eye(3)[p["_y"]], p["_w"].to_numpy()
    scores = np.tile(np.log(shares), (len(p), 1))
    for i in range(3):
        q = np.exp(scores) / np.exp(scores).sum(1, keepdims=True)
        g, h = y - q, 1.5 * q * (1 - q)
        step = np.zeros_like(scores)
        for c in range(3):
            leaf = ensembles[c].trees[i].transform(rows).orderBy("ID").toPandas()[f"_leaf{c}"].to_numpy().astype(int)
            for n in set(leaf):
                value = (w * g[:, c])[leaf == n].sum() / ((w * h[:, c])[leaf == n].sum() + 1)
                assert ensembles[c].values[i][n] == pytest.approx(value)
                step[leaf == n, c] = value
        scores += 0.4 * step
    got = rows
    for c in range(3):
        got = ensembles[c].score(got, f"s{c}")
    np.testing.assert_allclose(got.orderBy("ID").select("s0", "s1", "s2").toPandas().to_numpy(), scores, atol=1e-9)


def log_loss(df):
    return df.agg(F.avg(-F.log(F.greatest(F.get("p", F.col("k")), F.lit(1e-7))))).first()[0]


def test_boosted_classes_beat_a_forest(data):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import vector_to_array

    train, rest = data.filter("fold != 0"), data.filter("fold = 0")
    model = models.class_probabilities(["x", "z"], "k", 4, Trees(rounds=8, depth=2, rate=0.5, patience=3, group="g"))(train)
    got = model(rest, "p").select("p", "k").cache()
    assert got.filter(F.abs(F.aggregate("p", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0
    assert got.filter("p[3] != 0").count() == 0  # a class that training lacks
    forest = RandomForestClassifier(featuresCol="_x", labelCol="k", numTrees=8, maxDepth=2, seed=1).fit(models.assemble(train, ["x", "z"]))
    other = forest.transform(models.assemble(rest, ["x", "z"])).select(vector_to_array("probability").alias("p"), "k")
    assert log_loss(got) < log_loss(other)
    assert len(model.errors) >= model.rounds


def test_classes_without_labels_and_with_one_class(spark, data):
    one = models.class_probabilities(["x"], "k", 3, Trees(rounds=1, depth=1))(data.filter("k = 1"))(data.limit(3), "p")
    assert all(r.p == [0.0, 1.0, 0.0] for r in one.collect())
    none = models.class_probabilities(["x"], "k", 2, Trees(rounds=1))(data.withColumn("k", F.lit(None).cast("int")))(data.limit(2), "p")
    assert all(r.p == [0.0, 0.0] for r in none.collect())


def test_quantile_boosting_stops_early(spark):
    df = noisy(spark)
    model = models.quantile_regressor(["x", "z"], "y", 0.6, Trees(rounds=10, depth=4, rate=0.8, patience=2, group="g"))(df)
    assert model.rounds == boosting.stop_round(model.errors, 2) and len(model.errors) < 10


def test_ridge_takes_the_penalty_of_least_leave_one_out_error(spark):
    r = np.random.default_rng(9)
    x = r.normal(size=(60, 3)) * [1, 5, 0.1] + [0, 10, -3]
    x[:, 2] = x[:, 0] * 0.1 + r.normal(size=60) * 0.001
    y = x @ [1.0, 0.3, 2.0] + r.normal(size=60) * 4 + 20
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    alphas = (0.01, 0.1, 1.0, 10.0, 100.0)
    model = models.ridge_stack(["a", "b", "c"], "y", alphas)(df)

    z = (x - x.mean(0)) / x.std(0)

    def fitted(z, y, alpha):
        """Ridge with an intercept that isn't penalised, over columns that aren't scaled anew."""
        d = np.hstack([np.ones((len(z), 1)), z])
        return np.linalg.solve(d.T @ d + alpha * np.diag([0, 1, 1, 1]), d.T @ y)

    want = {}
    for a in alphas:
        left = [y[i] - np.array([1, *z[i]]) @ fitted(np.delete(z, i, 0), np.delete(y, i), a) for i in range(60)]
        want[a] = np.mean(np.square(left))
    assert model.penalties == pytest.approx(want) and model.alpha == min(alphas, key=want.get)
    w = fitted(z, y, model.alpha)
    got = model(df.filter("a IS NOT NULL AND y IS NOT NULL"), "p").toPandas()["p"].to_numpy()
    np.testing.assert_allclose(got, np.maximum(np.hstack([np.ones((60, 1)), z]) @ w, 0), atol=1e-8)
    with pytest.raises(ValueError):
        models.ridge_stack(["a"], "y")(df.limit(0))


def test_fallback_models_fit_the_logarithm(data):
    made = models.fallback_models(["x", "z"], "y", "g", rounds=2, patience=1)
    for fit in made.values():
        model = fit(data)
        raw = model.forest.transform(models.assemble(data, ["x", "z"])).agg(F.max("prediction")).first()[0]
        assert raw < np.log1p(60) and model(data, "p").agg(F.max("p")).first()[0] > 10
    assert set(made) == {"lgbm", "xgb", "cat"} and made["lgbm"](data).errors


def test_fits_of_classes_read_written_gradients(data, monkeypatch):
    """A fit reads its rows several times: no score is turned into a probability there, and no table is left over."""
    rows = models.assemble(data.select(F.col("k").alias("_y"), F.lit(1.0).alias("_w"), F.lit(False).alias("_valid"), "x", "z"), ["x", "z"])
    plans, tables, gone = [], [], []
    grown, write, drop = boosting._grown, boosting.written, boosting.drop_written

    class Spy:
        def __init__(self, made):
            self.made = made

        def fit(self, df):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().lower())
            return self.made.fit(df)

    monkeypatch.setattr(boosting, "_grown", lambda *a: Spy(grown(*a)))
    monkeypatch.setattr(boosting, "written", lambda *a: tables.append(write(*a)) or tables[-1])
    monkeypatch.setattr(boosting, "drop_written", lambda *t: gone.extend(t) or drop(*t))
    boosting.softmax_boost(rows, [0.5, 0.3, 0.2], Trees(rounds=2, depth=1, rate=0.4))
    assert len(plans) == 6 and not [p for p in plans if "lambda" in p or "exp(" in p or "relation" not in p]
    assert len(tables) == 2 and {t.path_written for t in gone} == {t.path_written for t in tables}
