"""Rolling means and deviations against DuckDB's, bit by bit, and the query whose flags depend on them."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests import oracle
from tidewater.functions.nulls import row_std
from tidewater.operators.blocked import BlockedPanel, hash_group
from tidewater.operators.quantiles import exact_quantiles
from tidewater.plans.queries import ORACLES, QUERIES

P = BlockedPanel("g", ("ID",))


def test_hash_groups_are_those_of_duckdb():
    keys = pd.Series([0, 1, -1, 41, 2**63 - 1, -(2**63), None, *range(10**9, 10**9 + 50)], dtype="Int64")
    con = duckdb.connect()
    con.execute("CREATE TABLE k (i BIGINT, g BIGINT)")
    con.executemany("INSERT INTO k VALUES (?, ?)", [(i, None if pd.isna(g) else int(g)) for i, g in enumerate(keys)])
    for bits in (4, 7):
        want = [r[0] for r in con.sql(f"SELECT (hash(g) >> {48 - bits}) & {2**bits - 1} FROM k ORDER BY i").fetchall()]
        assert hash_group(keys, bits).tolist() == want


def test_rolls_equal_duckdb_to_the_last_bit(spark, tmp_path):
    draw = random.Random(5)
    rows = [(g, i, None if draw.random() < 0.1 else draw.randrange(101) / 100.73918273) for i, g in enumerate(draw.choices([None, -7, *range(60)], k=4000))]
    spark.createDataFrame(rows, "g long, ID long, x double").write.parquet(f"{tmp_path}/t")
    placed = P.placed(P.with_slot(spark.read.parquet(f"{tmp_path}/t")))
    windows = [(n, how) for n in (13, 20, 21, 31) for how in ("mean", "std")]
    got = placed.select("ID", *[P.roll("x", n, how).alias(f"{how}{n}") for n, how in windows]).orderBy("ID").collect()
    over = "OVER (PARTITION BY g ORDER BY ID ROWS BETWEEN {} PRECEDING AND 1 PRECEDING)"
    sql = ", ".join(f"{'avg' if how == 'mean' else 'stddev_samp'}(x) {over.format(n)}" for n, how in windows)
    want = duckdb.sql(f"SELECT ID, {sql} FROM '{tmp_path}/t/*.parquet' ORDER BY ID").fetchall()
    assert [tuple(r) for r in got] == want


def test_quantiles_equal_duckdb_to_the_last_bit(spark):
    draw = random.Random(1)
    rows = [(g, draw.choice((draw.random(), -100 * draw.random(), 0.3))) for g in range(60) for _ in range(draw.randrange(1, 40))]
    wanted = {f"q{q}": ("x", q / 100) for q in (0, 30, 50, 80, 85)}
    got = exact_quantiles(spark.createDataFrame(rows, "g int, x double"), {"x": F.col("x")}, wanted, ["g"]).orderBy("g").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (g INT, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = con.sql(f"SELECT g, {', '.join(f'quantile_cont(x, {q})' for _, q in wanted.values())} FROM t GROUP BY g ORDER BY g").fetchall()
    assert [tuple(r) for r in got] == want


def test_windows_of_two_blocks_are_refused():
    with pytest.raises(ValueError, match="one block"):
        P.roll("x", 32, "mean")


def test_equal_values_have_no_deviation(spark):
    x = F.lit(0.42968101500017297)
    assert spark.range(1).select(row_std(x, x, x)).first()[0] == 0.0


def test_neighbour_features_of_windows_with_equal_means(spark, tmp_path, monkeypatch):
    draw = random.Random(7)
    users = draw.choices(range(40), k=3000)
    steps = [draw.choice((0, 29, 58, 87)) for _ in users]  # four values of pack_utilization, so that windows often have the threshold's mean
    rows = [(101 * i + s, u, "view", round(draw.expovariate(0.02), 2)) for i, (s, u) in enumerate(zip(steps, users))]
    (tmp_path / "small").mkdir()
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/small/events.parquet")
    monkeypatch.setattr(oracle, "ROOT", str(tmp_path))
    monkeypatch.setattr(oracle, "TABLES", ["events"])
    files = duckdb.connect
    monkeypatch.setattr(oracle.duckdb, "connect", lambda: _Views(files(), tmp_path))
    assert oracle.difference(spark, "small", "neighbour_features", QUERIES["neighbour_features"], ORACLES["neighbour_features"]) is None


class _Views:
    """A connection that reads a table which Spark wrote as several files."""

    def __init__(self, con, root):
        self.con, self.root = con, root

    def sql(self, text):
        return self.con.sql(text.replace("events.parquet'", "events.parquet/*.parquet'"))
