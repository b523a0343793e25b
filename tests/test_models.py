import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater import registry
from tidewater.ml import evaluate, models
from tidewater.operators import features
from tidewater.pipeline import Settings, TARGET, context_features, run


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    x, z = r.uniform(0, 10, 600), r.uniform(0, 1, 600)
    rows = [(i, i % 3, float(a), float(b), float(3 * a + r.exponential(4)), int(a > 6)) for i, (a, b) in enumerate(zip(x, z))]
    return spark.createDataFrame(rows, "ID int, fold int, x double, z double, y double, k int").cache()


def mae(df, out="pred"):
    return df.agg(F.avg(F.abs(F.col(out) - F.col("y")))).first()[0]


def test_absolute_and_log_models_beat_the_median(data):
    median = data.agg(F.percentile("y", F.lit(0.5))).first()[0]
    base = data.agg(F.avg(F.abs(F.col("y") - median))).first()[0]
    for log in (False, True):
        oof, test, importance = models.out_of_fold(data, data.limit(5), models.absolute_regressor(["x", "z"], "y", models.Trees(rounds=8, depth=3, rate=0.3), log=log), folds=3)
        assert oof.count() == 600 and mae(oof) < 0.6 * base and test.count() == 5
        got = {r.feature: r.v for r in importance.groupBy("feature").agg(F.avg("importance").alias("v")).collect()}
        assert got["x"] > got["z"]


def test_gate_and_classes(data):
    oof, _, _ = models.out_of_fold(data, None, models.binary_classifier(["x", "z"], "k", models.Trees(rounds=4, depth=2)), out="p", folds=3)
    assert oof.filter((F.col("p") > 0.5) == (F.col("k") == 1)).count() > 580
    one = models.binary_classifier(["x"], "k")(data.filter("k = 1"))(data, "p")
    assert one.select("p").distinct().collect()[0][0] == 1.0
    p = models.class_probabilities(["x"], "k", 4, models.Trees(rounds=3, depth=2))(data)(data, "p").first().p
    assert len(p) == 4 and p[2:] == [0.0, 0.0] and sum(p) == pytest.approx(1)


def test_quantile_model_covers_its_share(data):
    for alpha in (0.3, 0.8):
        got = models.quantile_regressor(["x"], "y", alpha, models.Trees(rounds=8, depth=3, rate=0.5))(data)(data, "pred")
        assert abs(got.agg(F.avg((F.col("y") <= F.col("pred")).cast("double"))).first()[0] - alpha) < 0.08


def test_ridge_equals_its_normal_equations(data):
    model = models.ridge_stack(["x", "z"], "y")(data)
    p = data.toPandas()
    x = p[["x", "z"]].to_numpy()
    mean, std = x.mean(0), x.std(0)
    w = np.linalg.solve(((x - mean) / std).T @ ((x - mean) / std) + model.alpha * np.eye(2), ((x - mean) / std).T @ (p["y"] - p["y"].mean()))
    want = np.maximum((x - mean) / std @ w + p["y"].mean(), 0)
    got = model(data, "pred").orderBy("ID").toPandas()["pred"].to_numpy()
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_pipeline_end_to_end(spark, few_partitions, tmp_path):
    r = np.random.default_rng(5)
    names = "order_inflow_15m unique_sku_15m avg_items_per_order heavy_item_ratio avg_trip_distance battery_mean low_battery_ratio robot_utilization robot_charging congestion_score pack_utilization backorder_ratio robot_idle".split()
    ids = [(f"s{g:02}", t) for g in range(12) for t in range(10)]
    for part, groups in (("train", range(8)), ("test", range(8, 12))):
        rows = [(f"{g}_{t:02}", g, int(g[1:]) % 3, *(None if r.random() < 0.05 else float(r.uniform(0, 1)) for _ in names), *([float(r.exponential(40))] if part == "train" else [])) for g, t in ids if int(g[1:]) in groups]
        schema = "ID string, scenario_id string, layout_id int, " + ", ".join(f"{n} double" for n in names) + (f", {TARGET} double" if part == "train" else "")
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/train.parquet" if part == "train" else f"{tmp_path}/test.parquet")
    spark.createDataFrame([(i, ("hub_spoke", "narrow", "grid")[i], 5.0 + i, 20.0, 4.0) for i in range(3)], "layout_id int, layout_type string, pack_station_count double, robot_total double, charger_count double").write.parquet(f"{tmp_path}/layout_info.parquet")
    s = Settings(f"{tmp_path}/out", windows=(3,), lags=(1,), folds=2, trees=models.Trees(rounds=2, depth=2, patience=1, group="scenario_id"), bin_trees=models.Trees(rounds=1, depth=1), bins=("stable",), last_rounds=2, context=True, context_windows=(4,), top=40)
    got = run(spark, str(tmp_path), s)
    assert got.count() == 40 and got.filter(F.col(TARGET) < 0).count() == 0 and got.columns == ["ID", TARGET]
    out = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    assert out("bin_report").count() == 5
    kinds = {f.kind for f in registry.lineage(out("context")).values()}
    assert kinds == {"lag", "diff", "roll", "bottleneck", "layout", "late", "scenario", "first4", "persistence", "neighbour", "probability", "backlog", "rank", "prediction", "context", "category"}
    wide = registry.Registry.of(out("context"), without=(TARGET, "fold"))
    assert wide.windows() == [3] and sum(f.kind == "context" for f in wide.features.values()) > 150
    assert {r.fold for r in out("context_model_rounds").collect()} == {0, 1} and out("context_model_rounds").filter("best_iteration BETWEEN 1 AND 2").count() == 2
    final = out("final")
    assert final.filter("stacked IS NULL OR weighted IS NULL").count() == 0 and final.count() == 120
    assert {r.model_name for r in out("summary").collect()} == {"best", "lgbm", "xgb", "cat", "weighted", "averaged", "stacked"}
    assert out("low").filter("delay_stable_prob_bin_0_10 > 0").count() > 0 and out("low").filter("delay_stable_prob_expected_bin_mid IS NULL").count() == 0


def test_context_covers_all_columns_that_change_within_a_scenario(spark):
    r = np.random.default_rng(4)
    plain = [*features.RANK_COLUMNS, "robot_active", "robot_total", "pack_station_count", "backorder_ratio", "label_print_queue", "base_pred"]
    x = r.uniform(0, 1, (40, len(plain)))
    rows = [(f"{i:03}", f"s{i // 20}", "train" if i < 20 else "test", 1, i % 20, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "ID string, scenario_id string, split string, layout_id int, timeslot int, " + ", ".join(f"{c} double" for c in plain))
    got = context_features(df, spark.createDataFrame([(1, "grid")], "layout_id int, layout_type string"))
    context = [c for c in got.columns if "ctxroll" in c]
    assert len(context) == 99 * 12 and len(features.context_columns(got, "base_pred")) == 99
    p = x[:20, plain.index("base_pred")]
    values = [tuple(row) for row in got.filter("split = 'train'").select("base_pred_ctxroll19_mean", "base_pred_vs_ctxroll19_mean", "sc_rank_robot_idle_ctxroll25_max", "ID").orderBy("ID").collect()]
    rank = x[:20, plain.index("robot_idle")].argsort().argsort() + 1
    assert values[0][:3] == (0, 0, 0)
    for i in range(1, 20):
        assert values[i][:3] == pytest.approx((p[:i].mean(), p[i] - p[:i].mean(), rank[:i].max() / 20))


def test_dual_validation_writes_all_reports(spark, few_partitions, data, tmp_path):
    df = data.withColumn("g", F.col("ID") % 20).drop("fold").withColumnRenamed("y", "t")
    fits = {"a": models.linear_model(["x"], "t"), "b": models.linear_model(["z"], "t")}
    got = {(r.model_name, r.validation): r for r in evaluate.dual(df, fits, "t", "g", str(tmp_path), folds=2).collect()}
    assert set(got) == {(m, v) for m in "ab" for v in (evaluate.GROUPED, evaluate.HOLDOUT)}
    assert got["a", evaluate.GROUPED].n_rows == 600 and got["a", evaluate.HOLDOUT].n_rows == 120
    assert got["a", evaluate.GROUPED].mae < got["b", evaluate.GROUPED].mae
    assert spark.read.parquet(f"{tmp_path}/bin_report").count() == 20 and spark.read.parquet(f"{tmp_path}/fold_report").count() == 4


def test_class_probabilities_out_of_fold_are_means_of_arrays(spark):
    rows = [(i, i % 3, float(i % 4), float(i % 7), None if i == 5 else i % 4) for i in range(120)]
    df = spark.createDataFrame(rows, "ID long, fold int, a double, b double, y int")
    fit = models.class_probabilities(["a", "b"], "y", 5, models.Trees(rounds=3, depth=3))
    oof, mean, _ = models.out_of_fold(df.filter("y IS NOT NULL"), df.limit(7), fit, out="p", folds=3)
    assert oof.count() == 119
    got = mean.collect()
    assert len(got) == 7 and all(len(r.p) == 5 and abs(sum(r.p) - 1) < 1e-9 and r.p[4] == 0 for r in got)
