"""Ordered-window operators against values worked out by hand and against pandas on random panels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.functions import nulls
from tidewater.operators import features, fill
from tidewater.operators.panel import Panel

P = Panel("g", ("ID",))


def rows(spark, values, kind="double"):
    return P.with_slot(spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], f"g string, ID int, x {kind}"))


def column(df, c):
    return [r[0] for r in df.withColumn("_y", c).orderBy("g", "ID").select("_y").collect()]


@pytest.mark.parametrize(
    "values, make, want",
    [
        ([None, None, 1.0, None, 3.0, None], lambda: P.linear("x"), [1, 1, 1, 2, 3, 3]),
        ([None, None, 1.0, None, 3.0, None], lambda: P.linear("x", causal=True), [None, None, 1, 1, 3, 3]),
        ([1.0, 2.0, 4.0, 7.0, 11.0, 16.0, 22.0, 29.0], lambda: P.slope("x"), [None] * 5 + [2.5, 3.5, 4.5]),
        ([3.0, 1.0, 1.0, None, 2.0], lambda: P.rank_pct("x"), [1.0, 0.375, 0.375, None, 0.75]),
        ([1.0, None, 3.0, 5.0], lambda: P.roll("x", 3, "mean"), [None, 1, 1, 2]),
        ([1.0, None, 3.0, 5.0], lambda: P.roll("x", 3, "std"), [None, None, None, 2**0.5]),
        ([4.0, 6.0, 8.0], lambda: P.cumulative_family("x")["cummean_prev"], [0, 2, 10 / 3]),
        ([4.0, 6.0, 8.0], lambda: P.expanding("x", "mean"), [None, 4, 5]),
        ([4.0, 6.0, 8.0], lambda: P.ewm("x", 0.7), [0, 1.2, 2.64]),
        ([None, -1.0, 2.0], lambda: nulls.floor_at(F.col("x")), [None, 0, 2]),
        ([1.0, 5.0, 5.0, 1.0, 5.0], lambda: P.state_count(F.col("x") > 2, 3), [0, 0, 1, 2, 2]),
        ([2.0, 2.0, 2.0], lambda: P.relative("x")["z"], [0, 0, 0]),
        ([None, 2.0, None], lambda: P.forward_back("x"), [2, 2, 2]),
    ],
)
def test_known_values(spark, values, make, want):
    got = column(rows(spark, values), make())
    assert [g if g is None else pytest.approx(g, abs=1e-9) for g in got] == want


def test_all_missing_group_gets_the_sentinel(spark):
    df = rows(spark, [None, None]).withColumnRenamed("x", "x_lag1")
    assert [r.x_lag1 for r in fill.fill(df, ["x_lag1"], "linear", P).collect()] == [-999.0, -999.0]
    with pytest.raises(ValueError):
        fill.fill(df, ["x_lag1"], "other", P)


def test_runs_and_crossings(spark):
    df = rows(spark, [5.0, 5.0, 1.0, 5.0, 5.0, 5.0])
    got = P.add_crossings(P.add_runs(df, {"run": F.col("x") > 2}), {"s": (F.col("x") > 2, {"cross": 3})}).orderBy("ID").collect()
    assert [r.run for r in got] == [0, 1, 2, 0, 1, 2] and [r.cross for r in got] == [0, 1, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def random_panel():
    r = np.random.default_rng(3)
    parts = [(f"g{i:02}", j, None if r.random() < 0.15 else round(float(r.uniform(0, 9)), 1)) for i in range(40) for j in range(int(r.integers(1, 26)))]
    parts += [("none", j, None) for j in range(5)] + [("same", j, 4.0) for j in range(7)]
    return pd.DataFrame(parts, columns=["g", "ID", "x"]).astype({"x": float}).sort_values(["g", "ID"]).reset_index(drop=True)


def test_random_panel_equals_pandas(spark, random_panel):
    p, g = random_panel, random_panel.groupby("g", sort=False)["x"]
    prev, by = g.shift(1), random_panel["g"]
    roll = lambda n, how: getattr(prev.groupby(by, sort=False).rolling(n, min_periods=1), how)().reset_index(level=0, drop=True)
    want = pd.DataFrame({
        "lag2": g.shift(2), "diff3": p["x"] - g.shift(3), "mean4": roll(4, "mean"), "max4": roll(4, "max"), "std4": roll(4, "std"), "cumsum": prev.fillna(0).groupby(by, sort=False).cumsum(),
        "ewm": prev.fillna(0).groupby(by, sort=False).transform(lambda s: s.ewm(alpha=0.15, adjust=False).mean()), "rank": g.rank(pct=True), "p75": g.transform(lambda s: s.quantile(0.75)),
        "linear": g.transform(lambda s: s.interpolate(limit_direction="both")), "fill": g.transform(lambda s: s.ffill().bfill()), "first4": np.where(p.groupby("g").cumcount() >= 4, g.transform(lambda s: s.iloc[:4].mean()), 0.0),
    })
    df = P.with_slot(spark.createDataFrame([(a, int(b), None if np.isnan(c) else float(c)) for a, b, c in p.itertuples(index=False)], "g string, ID int, x double"))
    got = df.select("g", "ID", P.lag("x", 2).alias("lag2"), P.diff("x", 3).alias("diff3"), *[P.roll("x", 4, h).alias(f"{h}4") for h in ("mean", "max", "std")], P.cumulative_sum("x").alias("cumsum"), P.ewm("x", 0.85).alias("ewm"), P.rank_pct("x").alias("rank"), P.quantile("x", 0.75).alias("p75"), P.linear("x").alias("linear"), P.forward_back("x").alias("fill"), P.first_n("x", "mean").alias("first4")).toPandas().sort_values(["g", "ID"]).reset_index(drop=True)
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, err_msg=c)


def test_past_columns_do_not_see_later_rows(spark, random_panel):
    base = random_panel[random_panel.groupby("g").cumcount() < 12]
    changed = base.assign(x=np.where(base.groupby("g").cumcount() >= 6, 99.0, base["x"]))
    cols = [P.roll("x", 5, "mean").alias("a"), P.cumulative_sum("x").alias("b"), P.ewm("x", 0.7).alias("c"), P.slope("x").alias("d"), P.expanding("x", "max").alias("e")]
    out = []
    for frame in (base, changed):
        df = spark.createDataFrame([(a, int(b), None if np.isnan(c) else float(c)) for a, b, c in frame.itertuples(index=False)], "g string, ID int, x double")
        out.append(sorted((tuple(r) for r in P.with_slot(df).select("g", "ID", "timeslot", *cols).filter("timeslot <= 6").collect()), key=str))
    assert out[0] == out[1]


def test_rolling_layer_has_one_exchange(spark):
    df = rows(spark, [1.0, 2.0]).select("g", "ID", "x")
    plan = P.with_slot(df).select("*", *[P.roll("x", n, h).alias(f"r{n}{h}") for n in range(2, 12) for h in ("mean", "max", "std")])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_unselected_windows_are_not_planned(spark):
    df = rows(spark, [1.0, 2.0])
    wide = df.select("*", *[P.roll("x", n, "mean").alias(f"r{n}") for n in range(2, 25)]).select("ID", "r19")
    assert "21 PRECEDING" not in wide._jdf.queryExecution().optimizedPlan().toString()


def test_missing_values_are_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r.x for r in nulls.sanitise(df).collect()] == [1.0, None, None, None]
    assert column(spark.createDataFrame([("a", 0, 1.0, 0.0)], "g string, ID int, x double, y double"), nulls.safe_div(F.col("x"), F.col("y"))) == [1e6]
    assert [r[0] for r in df.select(nulls.flag(F.col("x") > 0)).collect()][3] == 0


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 9.9, 10.0, 50.0, 300.0, 301.0)], "x double")
    assert [r[0] for r in df.select(features.digitise(F.col("x"))).collect()] == [0, 0, 1, 5, 9, 9]
    assert features.bin_labels(features.STABLE)[-1] == "bin_100_inf"


def test_optional_columns_default(spark):
    df = spark.createDataFrame([(1,)], "ID int")
    assert df.select(nulls.col_or(df, "robot_active").alias("a"), nulls.col_or(df, "ID", 7).alias("b")).first() == (0.0, 1)


def test_categories_of_alike_names_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a b", "train"), (2, "a-b", "train"), (3, None, "test")], "ID long, layout_type string, split string")
    got = {r.ID: r for r in features.add_layout_encoding(df).collect()}
    assert (got[1].layout_type_oh_a_b, got[1].layout_type_oh_a_b__2) == (1, 0) and (got[2].layout_type_oh_a_b, got[2].layout_type_oh_a_b__2) == (0, 1)
    assert got[3].layout_type_oh_missing == 1 and got[3].layout_type_freq == 0
