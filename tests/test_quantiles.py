import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import hygiene
from tidewater.operators.panel import Panel
from tidewater.operators.quantiles import exact_quantiles

WANTED = {"a0": ("a", 0.0), "a30": ("a", 0.3), "a99": ("a", 0.99), "b50": ("b", 0.5), "b100": ("b", 1.0)}


@pytest.fixture(scope="module")
def numbers():
    r = np.random.default_rng(3)
    n = 30_000
    a = r.lognormal(0, 2, n)
    b = np.where(r.random(n) < 0.4, 7.0, r.integers(0, 50, n) / 4)  # one value in two fifths of all rows
    return pd.DataFrame({"k": r.choice(["x", "y", None], n, p=[0.8, 0.15, 0.05]), "a": a, "b": np.where(r.random(n) < 0.1, np.nan, b)})


def given(spark, frame):
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "k string, a double, b double").repartition(7)


def columns():
    return {"a": F.col("a"), "b": F.col("b")}


@pytest.mark.parametrize("most_left", [10**6, 500, 1])
def test_quantiles_at_any_number_of_values_left(spark, numbers, most_left):
    got = exact_quantiles(given(spark, numbers), columns(), WANTED, most_left=most_left).first().asDict()
    assert got == pytest.approx({n: numbers[c].quantile(q) for n, (c, q) in WANTED.items()}, rel=1e-12)


def test_quantiles_of_groups_with_a_null_key(spark, numbers):
    got = {r.k: r.asDict() for r in exact_quantiles(given(spark, numbers), columns(), WANTED, ["k"], most_left=300).collect()}
    assert set(got) == {"x", "y", None}
    for k, rows in numbers.groupby("k", dropna=False):
        k = None if pd.isna(k) else k
        assert {n: got[k][n] for n in WANTED} == pytest.approx({n: rows[c].quantile(q) for n, (c, q) in WANTED.items()}, rel=1e-12)


def test_quantiles_without_values(spark):
    none = spark.createDataFrame([], "k string, a double, b double")
    assert [set(r) for r in exact_quantiles(none, columns(), WANTED).collect()] == [{None}]
    assert exact_quantiles(none, columns(), WANTED, ["k"]).count() == 0
    nulls = spark.createDataFrame([("x", None, None), ("x", 2.0, None)], none.schema)
    assert exact_quantiles(nulls, columns(), WANTED, ["k"]).first().asDict() == {"k": "x", "a0": 2.0, "a30": 2.0, "a99": 2.0, "b50": None, "b100": None}


def test_decay_of_a_long_entity_equals_the_whole_fold(spark):
    x = np.random.default_rng(5).normal(0, 100, 3000)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "g int, i int, x double")
    p = Panel("g", ("i",))
    got = [(r.a, r.b) for r in df.select("i", p.ewm("x", 0.7).alias("a"), p.ewm("x", 0.95).alias("b")).orderBy("i").collect()]
    want, y = [], [0.0, 0.0]
    for v in x:
        want.append(tuple(y))
        y = [d * s + (1 - d) * v for d, s in zip((0.7, 0.95), y)]
    assert np.allclose(got, want, rtol=1e-12, atol=1e-12)


def test_near_constant_columns(spark):
    rows = [(i, "s" if i else "t", None, 1.0 if i % 2 else 2.0, 5, None if i < 1 else 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, nearly string, gone double, half double, same int, rare int")
    cols = ["i", "nearly", "gone", "half", "same", "rare"]
    got = {r["column"]: (r.n_distinct, r.top_share) for r in hygiene.near_constant(df, cols).collect()}
    assert got == {"nearly": (2, 0.9995), "gone": (1, 1.0), "same": (1, 1.0), "rare": (2, 0.9995)}
    assert {r["column"] for r in hygiene.near_constant(df, cols, 0.5).collect()} == set(got) | {"half"}
    assert hygiene.near_constant(df, ["i", "half"]).count() == 0 and hygiene.near_constant(df.limit(0), cols).count() == 0
