"""Registered queries of the panel operators, each with the DuckDB SQL that gives the same rows.

The tables of the driver stand in for the dispatch-delay panel: an event is a slot, its user the scenario, and the
measures derive from its number and value by formulas that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewater.functions.nulls import clean, flag, row_mean, row_std, safe_div
from tidewater.operators import blend, features, fill, hygiene, reports, split, validate
from tidewater.operators.blocked import BlockedPanel
from tidewater.operators.features import SCENARIO as P
from tidewater.sources.shared import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# Stand-in columns, as SQL that Spark and DuckDB share.
STAND_IN = {
    "ID": "event_id",
    "scenario_id": "user_id",
    "layout_id": "user_id % 7",
    "split": "CASE WHEN user_id % 5 <> 0 THEN 'train' ELSE 'test' END",
    "target": "value",
    "order_inflow_15m": "value * 0.91736458291e0",
    "battery_mean": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE ln(1e0 + value) END",
    "low_battery_ratio": "(event_id % 17) / 17e0",
    "robot_utilization": "(event_id % 13) / 13e0",
    "robot_charging": "(event_id % 5) * 1.037194e0 + value / 917.36e0",
    "congestion_score": "value / 437.1934717e0",
    "pack_utilization": "((event_id * 7) % 101) / 100.73918273e0",
    "backorder_ratio": "CASE WHEN value > 300e0 THEN (value - 300e0) / 203.71938e0 ELSE 0e0 END",
    "robot_idle": "(event_id % 9) * 1e0",
    "avg_items_per_order": "1e0 + event_id % 4",
    "unique_sku_15m": "(event_id % 23) * 1.0173948e0",
    "heavy_item_ratio": "(event_id % 11) / 11e0",
    "avg_trip_distance": "value / 10.31739e0",
    "charge_queue_length": "(event_id % 6) * 1e0",
    "loading_dock_util": "(event_id % 19) / 19e0",
    "outbound_truck_wait_min": "value / 7.137391e0",
    "robot_active": "(event_id % 31) * 1.0739184e0",
    "label_print_queue": "(event_id % 8) * 1e0",
    "pack_station_count": "3e0 + user_id % 7",
    "robot_total": "10e0 + 3 * (user_id % 7)",
}
_COLUMNS = ", ".join(f"{e} AS {n}" for n, e in STAND_IN.items())
BASE = f"d0 AS (SELECT {_COLUMNS}, event_type FROM events), d AS (SELECT *, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY ID) - 1 AS INTEGER) AS timeslot FROM d0)"
G = "PARTITION BY scenario_id"
O = f"{G} ORDER BY ID"


def past(n: int | None = None) -> str:
    return f"OVER ({O} ROWS BETWEEN {'UNBOUNDED' if n is None else n} PRECEDING AND 1 PRECEDING)"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_slot(events(spark, sf).selectExpr(*[f"{e} AS {n}" for n, e in STAND_IN.items()], "event_type"))


def shown(df: DataFrame, keys: list[str], **columns: Column | str) -> DataFrame:
    return df.select(*keys, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def rounded(df: DataFrame, keys: list[str], names: list[str], digits: int = 6) -> DataFrame:
    """keys and names in lower case, names rounded."""
    return df.select(*[F.col(k).alias(k.lower()) for k in keys], *[F.round(F.col(n).cast("double"), digits).alias(n.lower()) for n in names])


def sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([BASE, *more])} {body}"


def r(expression: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) AS {name}"


def pick(names: list[str], source: str = "f", keys: str = "ID AS id") -> str:
    return f"SELECT {keys}, {', '.join(r(n, n.lower()) for n in names)} FROM {source}"


# ---- ordered windows


@query(sql("SELECT ID AS id, CAST(timeslot AS INTEGER) AS timeslot FROM d"))
def panel_slot(spark, sf):
    return panel(spark, sf).select(F.col("ID").alias("id"), "timeslot")


_LAGS = [f"{c}_{k}{n}" for c in ("battery_mean", "order_inflow_15m", "congestion_score") for k, n in (("lag", 1), ("lag", 10), ("diff", 1), ("diff", 5))]
_LAG_SQL = ", ".join(f"{c} - lag({c}, {n}) OVER ({O}) AS {c}_{k}{n}" if k == "diff" else f"lag({c}, {n}) OVER ({O}) AS {c}_{k}{n}" for c in ("battery_mean", "order_inflow_15m", "congestion_score") for k, n in (("lag", 1), ("lag", 10), ("diff", 1), ("diff", 5)))


@query(sql(pick(_LAGS), f"f AS (SELECT ID, {_LAG_SQL} FROM d)"))
def panel_lag_diff(spark, sf):
    return rounded(features.add_lags(panel(spark, sf)), ["ID"], _LAGS)


_ROLLS = [f"{c}_roll{n}_{h}" for c in ("battery_mean", "order_inflow_15m") for n in (2, 19) for h in ("mean", "max", "std")]
_AGG = {"mean": "avg", "max": "max", "std": "stddev_samp"}
_ROLL_SQL = ", ".join(f"{_AGG[h]}({c}) {past(n)} AS {c}_roll{n}_{h}" for c in ("battery_mean", "order_inflow_15m") for n in (2, 19) for h in ("mean", "max", "std"))


@query(sql(pick(_ROLLS), f"f AS (SELECT ID, {_ROLL_SQL} FROM d)"))
def panel_roll_stats(spark, sf):
    return rounded(features.add_rolling(features.add_bottleneck(panel(spark, sf)), windows=(2, 19)), ["ID"], _ROLLS)


_INTER = ["congestion_vs_roll19", "congestion_roll19_x_pack", "robot_shortage_x_congestion_roll19", "pack_utilization_vs_roll19", "order_per_pack_station_roll19_mean", "order_per_pack_station_roll19_max", "order_per_pack_station_vs_roll19", "order_roll19_per_pack_station"]
_BOTTLE = """b AS (SELECT *, order_inflow_15m / (pack_station_count + 1e-6) AS order_per_pack_station, robot_total - robot_charging AS available_robot,
 1 - (robot_total - robot_charging) / (robot_total + 1e-6) AS robot_shortage_ratio FROM d)"""


@query(sql(pick(_INTER), _BOTTLE, f"""w AS (SELECT *, avg(congestion_score) {past(19)} AS c, avg(pack_utilization) {past(19)} AS p, avg(order_inflow_15m) {past(19)} AS o,
 avg(order_per_pack_station) {past(19)} AS q, max(order_per_pack_station) {past(19)} AS qm FROM b)""", """f AS (SELECT ID, congestion_score - c AS congestion_vs_roll19,
 c * pack_utilization AS congestion_roll19_x_pack, robot_shortage_ratio * c AS robot_shortage_x_congestion_roll19, pack_utilization - p AS pack_utilization_vs_roll19,
 q AS order_per_pack_station_roll19_mean, qm AS order_per_pack_station_roll19_max, order_per_pack_station - q AS order_per_pack_station_vs_roll19, o / (pack_station_count + 1e-6) AS order_roll19_per_pack_station FROM w)"""))  # fmt: skip
def panel_roll_interactions(spark, sf):
    return rounded(features.add_rolling(features.add_bottleneck(panel(spark, sf)), windows=(19,)), ["ID"], _INTER)


_CUM = [f"{c}_cumsum" for c in features.CUMSUM_COLUMNS]


@query(sql(pick(_CUM), "f AS (SELECT ID, " + ", ".join(f"coalesce(sum({c}) {past()}, 0) AS {c}_cumsum" for c in features.CUMSUM_COLUMNS) + " FROM d)"))
def panel_cumsum(spark, sf):
    return rounded(features.add_cumsum(panel(spark, sf)), ["ID"], _CUM)


@query(sql(pick(["m", "x"]), f"f AS (SELECT ID, avg(battery_mean) {past()} AS m, max(battery_mean) {past()} AS x FROM d)"))
def panel_expanding(spark, sf):
    return rounded(shown(panel(spark, sf), ["ID"], m=P.expanding("battery_mean", "mean"), x=P.expanding("battery_mean", "max")), ["ID"], ["m", "x"])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, ln(1e0 + o_totalprice) AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t FROM orders)
SELECT a.o_orderkey, round(coalesce(sum(CASE WHEN b.t IS NOT NULL THEN 0.3e0 * pow(0.7e0, a.t - 1 - b.t) * b.x END), 0), 6) AS d07, round(coalesce(sum(CASE WHEN b.t IS NOT NULL THEN 0.05e0 * pow(0.95e0, a.t - 1 - b.t) * b.x END), 0), 6) AS d095
FROM o a LEFT JOIN o b ON a.o_custkey = b.o_custkey AND b.t < a.t GROUP BY a.o_orderkey""")
def panel_ewm(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", F.log1p("o_totalprice").alias("x"))
    p = features.Panel("o_custkey", ("o_orderdate", "o_orderkey"))
    return orders.select("o_orderkey", F.round(p.ewm("x", 0.7), 6).alias("d07"), F.round(p.ewm("x", 0.95), 6).alias("d095"))


_SLOPES = [f"{c}_slope5" for c in features.SLOPE_COLUMNS]


@query(sql(pick(_SLOPES), "f AS (SELECT ID, " + ", ".join(f"CASE WHEN count({c}) {past(5)} = 5 THEN regr_slope({c}, timeslot) {past(5)} END AS {c}_slope5" for c in features.SLOPE_COLUMNS) + " FROM d)"))
def panel_slope5(spark, sf):
    return rounded(features.add_slope(panel(spark, sf)), ["ID"], _SLOPES)


_STATES = {"congestion_high": "congestion_score > 0.8e0", "pack_high": "pack_utilization > 0.9e0", "backorder_high": "backorder_ratio > 0", "robot_shortage_high": "robot_shortage_ratio > 0.2e0"}
_STATE_SQL = [_BOTTLE, "s0 AS (SELECT *, " + ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS n_{n}" for n, c in _STATES.items()) + " FROM b)", "s1 AS (SELECT *, " + ", ".join(f"coalesce(lag(n_{n}) OVER ({O}), 0) AS s_{n}" for n in _STATES) + " FROM s0)"]
_BREAKS = "s2 AS (SELECT *, " + ", ".join(f"sum(1 - s_{n}) OVER ({O}) AS b_{n}, CASE WHEN s_{n} = 1 AND coalesce(lag(s_{n}) OVER ({O}), 0) = 0 THEN 1 ELSE 0 END AS x_{n}" for n in _STATES) + " FROM s1)"


@query(sql("SELECT ID AS id, " + ", ".join(f"CAST(sum(s_{n}) OVER (PARTITION BY scenario_id, b_{n} ORDER BY ID) AS BIGINT) AS {n}_run_length" for n in _STATES) + " FROM s2", *_STATE_SQL, _BREAKS))
def persistence_run(spark, sf):
    df = features.add_persistence(features.add_bottleneck(panel(spark, sf)))
    return df.select(F.col("ID").alias("id"), *[F.col(f"{n}_run_length").cast("long").alias(f"{n}_run_length") for n in _STATES])


@query(sql("SELECT ID AS id, " + ", ".join(f"CAST(coalesce(sum(n_{n}) {past(w)}, 0) AS BIGINT) AS {n}_count_roll{w}, CAST(sum(x_{n}) OVER ({O} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) AS BIGINT) AS {n}_cross_roll{w}" for n in _STATES for w in (5, 24)) + " FROM s2", *_STATE_SQL, _BREAKS))
def persistence_roll(spark, sf):
    df = features.add_persistence(features.add_bottleneck(panel(spark, sf)))
    return df.select(F.col("ID").alias("id"), *[F.col(f"{n}_{k}_roll{w}").cast("long").alias(f"{n}_{k}_roll{w}") for n in _STATES for w in (5, 24) for k in ("count", "cross")])


_SO_FAR = {"sc_congestion_mean_so_far": "avg(congestion_score)", "sc_congestion_max_so_far": "max(congestion_score)", "sc_pack_mean_so_far": "avg(pack_utilization)", "sc_backorder_max_so_far": "max(backorder_ratio)", "sc_order_mean_so_far": "avg(order_inflow_15m)", "sc_robot_shortage_mean_so_far": "avg(robot_shortage_ratio)"}
_Q = lambda c, q, t="b": f"(SELECT quantile_cont({c}, {q}) FROM {t} WHERE split = 'train')"


@query(sql(pick([*_SO_FAR, "sc_order_sum_so_far", "sc_risk_count_so_far", "late16_sc_risk_count"]), _BOTTLE, "w AS (SELECT *, " + ", ".join(f"{e} {past()} AS {n}" for n, e in _SO_FAR.items()) + f", coalesce(sum(order_inflow_15m) {past()}, 0) AS sc_order_sum_so_far FROM b)",
 f"""v AS (SELECT *, CASE WHEN sc_congestion_max_so_far >= {_Q('congestion_score', 0.8)} THEN 1 ELSE 0 END + CASE WHEN sc_pack_mean_so_far >= {_Q('pack_utilization', 0.8)} THEN 1 ELSE 0 END
 + CASE WHEN sc_order_mean_so_far >= {_Q('order_inflow_15m', 0.8)} THEN 1 ELSE 0 END + CASE WHEN sc_robot_shortage_mean_so_far >= {_Q('robot_shortage_ratio', 0.8)} THEN 1 ELSE 0 END + CASE WHEN sc_backorder_max_so_far > 0 THEN 1 ELSE 0 END AS sc_risk_count_so_far FROM w)""",
 "f AS (SELECT *, CASE WHEN timeslot >= 16 THEN sc_risk_count_so_far ELSE 0 END AS late16_sc_risk_count FROM v)"))
def scenario_risk(spark, sf):
    return rounded(features.add_scenario_risk(features.add_bottleneck(panel(spark, sf))), ["ID"], [*_SO_FAR, "sc_order_sum_so_far", "sc_risk_count_so_far", "late16_sc_risk_count"])


_FIRST = {"congestion_mean": "avg(CASE WHEN timeslot < 4 THEN congestion_score END)", "pack_mean": "avg(CASE WHEN timeslot < 4 THEN pack_utilization END)", "order_mean": "avg(CASE WHEN timeslot < 4 THEN order_inflow_15m END)", "backorder_max": "max(CASE WHEN timeslot < 4 THEN backorder_ratio END)", "robot_shortage_mean": "avg(CASE WHEN timeslot < 4 THEN robot_shortage_ratio END)"}


@query(sql(pick([f"first4_{n}{s}" for n in _FIRST for s in ("", "_late16")]), _BOTTLE, "f AS (SELECT ID, " + ", ".join(f"CASE WHEN timeslot >= {t} THEN {e} OVER ({G}) ELSE 0 END AS first4_{n}{s}" for n, e in _FIRST.items() for s, t in (("", 4), ("_late16", 16))) + " FROM b)"))
def first4_summary(spark, sf):
    return rounded(features.add_first4(features.add_bottleneck(panel(spark, sf))), ["ID"], [f"first4_{n}{s}" for n in _FIRST for s in ("", "_late16")])


_BP = ["bp_order_pack_capacity_gap", "bp_order_robot_capacity_gap", "bp_robot_available_gap", "bp_pack_overload", "bp_robot_overload", "bp_demand_capacity_pressure", "bp_downstream_pressure", "bp_congestion_order_pressure", "bp_congestion_pack_overload", "bp_battery_robot_overload", "bp_backorder_pack_pressure"]
_BP_SQL = [
    "md AS (SELECT split, quantile_cont(abs(label_print_queue), 0.5) AS ml, quantile_cont(abs(outbound_truck_wait_min), 0.5) AS mt, quantile_cont(abs(charge_queue_length), 0.5) AS mc FROM d GROUP BY split)",
    """g AS (SELECT d.*, order_inflow_15m - pack_station_count * (1 - pack_utilization) AS bp_order_pack_capacity_gap, order_inflow_15m - robot_active * (1 - robot_utilization) AS bp_order_robot_capacity_gap,
 robot_total - robot_active - robot_charging AS bp_robot_available_gap, order_inflow_15m / (pack_station_count + robot_active + 1e-6) AS bp_demand_capacity_pressure,
 (pack_utilization + loading_dock_util + label_print_queue / (ml + 1e-6) + outbound_truck_wait_min / (mt + 1e-6)) / 4 AS bp_downstream_pressure, low_battery_ratio + charge_queue_length / (mc + 1e-6) AS lb FROM d JOIN md USING (split))""",
    """h AS (SELECT *, greatest(bp_order_pack_capacity_gap, 0) AS bp_pack_overload, greatest(bp_order_robot_capacity_gap, 0) AS bp_robot_overload, congestion_score * bp_demand_capacity_pressure AS bp_congestion_order_pressure FROM g)""",
    """k AS (SELECT *, congestion_score * bp_pack_overload AS bp_congestion_pack_overload, lb * bp_robot_overload AS bp_battery_robot_overload, backorder_ratio * bp_pack_overload AS bp_backorder_pack_pressure FROM h)""",
]


@query(sql(pick(_BP, "k"), *_BP_SQL))
def backlog_pressure(spark, sf):
    return rounded(features.add_backlog(panel(spark, sf)), ["ID"], _BP)


_FAMILY = [f"{c}_{n}" for c in ("bp_pack_overload", "bp_congestion_order_pressure") for n in ("cumsum_prev", "cummean_prev", "diff1", "diff_x_cumsum", "diff_x_cummean")] + ["bp_congestion_score_diff1_x_bp_congestion_order_pressure_cumsum_prev"]


@query(sql(pick(_FAMILY), *_BP_SQL, "k2 AS (SELECT *, " + ", ".join(f"coalesce(sum({c}) {past()}, 0) AS {c}_cumsum_prev, coalesce(sum({c}) {past()}, 0) / (timeslot + 1) AS {c}_cummean_prev, coalesce({c} - lag({c}) OVER ({O}), 0) AS {c}_diff1" for c in ("bp_pack_overload", "bp_congestion_order_pressure")) + f", coalesce(congestion_score - lag(congestion_score) OVER ({O}), 0) AS dc FROM k)",
 "f AS (SELECT *, " + ", ".join(f"{c}_diff1 * {c}_cumsum_prev AS {c}_diff_x_cumsum, {c}_diff1 * {c}_cummean_prev AS {c}_diff_x_cummean" for c in ("bp_pack_overload", "bp_congestion_order_pressure")) + ", dc * bp_congestion_order_pressure_cumsum_prev AS bp_congestion_score_diff1_x_bp_congestion_order_pressure_cumsum_prev FROM k2)"))
def backlog_cumulative(spark, sf):
    return rounded(features.add_backlog(panel(spark, sf)), ["ID"], _FAMILY)


_RANKED = ("order_inflow_15m", "battery_mean", "pack_utilization")
_RANK_SQL = lambda c: f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER ({G} ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY scenario_id, {c}) - 1) / 2e0) / count({c}) OVER ({G}) END"
_REL_SQL = lambda c: {"relmean": f"{c} - avg({c}) OVER ({G})", "z": f"coalesce(({c} - avg({c}) OVER ({G})) / (nullif(stddev_samp({c}) OVER ({G}), 0) + 1e-6), 0)", "to_max": f"{c} / (abs(max({c}) OVER ({G})) + 1e-6)", "range_pos": f"({c} - min({c}) OVER ({G})) / (abs(max({c}) OVER ({G}) - min({c}) OVER ({G})) + 1e-6)"}
_RANK_NAMES = [f"sc_{n}_{c}" for c in _RANKED for n in ("rank", "relmean", "z", "to_max", "range_pos")]


@query(sql(pick(_RANK_NAMES), "f AS (SELECT ID, " + ", ".join([f"{_RANK_SQL(c)} AS sc_rank_{c}" for c in _RANKED] + [f"{e} AS sc_{n}_{c}" for c in _RANKED for n, e in _REL_SQL(c).items()]) + " FROM d)"))
def scenario_rank_norm(spark, sf):
    return rounded(features.add_scenario_rank(panel(spark, sf)), ["ID"], _RANK_NAMES)


_PRED = f"p AS (SELECT *, coalesce(avg(order_inflow_15m) {past(3)}, 0) AS pred, coalesce(avg(order_inflow_15m) {past(10)}, 0) AS pred2 FROM d)"
_PC = ["sc_pred_rank", "sc_pred_relmean", "sc_pred_z", "sc_pred_to_p90", "sc_pred_to_p75", "sc_pred_to_max", "sc_pred_mean", "sc_pred_p75", "sc_pred_p90", "sc_pred_max", "sc_pred_rank_x_pred"]


def predicted(spark, sf) -> DataFrame:
    """Past means of 3 and 10 slots stand in for two models' predictions."""
    return panel(spark, sf).select("*", F.coalesce(P.roll("order_inflow_15m", 3, "mean"), F.lit(0.0)).alias("pred"), F.coalesce(P.roll("order_inflow_15m", 10, "mean"), F.lit(0.0)).alias("pred2"))


@query(sql(pick(_PC), _PRED, f"""q AS (SELECT ID, pred, {_RANK_SQL('pred')} AS sc_pred_rank, {", ".join(f"{e} AS sc_pred_{n}" for n, e in _REL_SQL('pred').items())}, avg(pred) OVER ({G}) AS sc_pred_mean,
 quantile_cont(pred, 0.75) OVER ({G}) AS sc_pred_p75, quantile_cont(pred, 0.9) OVER ({G}) AS sc_pred_p90, max(pred) OVER ({G}) AS sc_pred_max FROM p)""",
 "f AS (SELECT *, pred / (abs(sc_pred_p90) + 1e-6) AS sc_pred_to_p90, pred / (abs(sc_pred_p75) + 1e-6) AS sc_pred_to_p75, sc_pred_rank * pred AS sc_pred_rank_x_pred FROM q)"))
def prediction_context(spark, sf):
    return rounded(features.add_prediction_context(predicted(spark, sf), "pred"), ["ID"], _PC)


_CTX = [n for c in ("bp_pack_overload", "bp_downstream_pressure") for w in features.CONTEXT_WINDOWS for n in (f"{c}_ctxroll{w}_mean", f"{c}_ctxroll{w}_max", f"{c}_ctxroll{w}_std", f"{c}_vs_ctxroll{w}_mean")]
_CTX_SQL = ", ".join(f"coalesce(avg({c}) {past(w)}, 0) AS {c}_ctxroll{w}_mean, coalesce(max({c}) {past(w)}, 0) AS {c}_ctxroll{w}_max, coalesce(stddev_samp({c}) {past(w)}, 0) AS {c}_ctxroll{w}_std, coalesce({c} - avg({c}) {past(w)}, 0) AS {c}_vs_ctxroll{w}_mean" for c in ("bp_pack_overload", "bp_downstream_pressure") for w in features.CONTEXT_WINDOWS)


@query(sql(pick(_CTX), *_BP_SQL, f"f AS (SELECT ID, {_CTX_SQL} FROM k)"))
def context_rolling(spark, sf):
    return rounded(features.add_context_rolling(features.add_backlog(panel(spark, sf)), ["bp_pack_overload", "bp_downstream_pressure"]), ["ID"], _CTX)


# ---- filling

_GAPS = f"m AS (SELECT ID, scenario_id, timeslot, CASE WHEN ID % 3 = 0 OR ID % 5 = 0 THEN NULL ELSE order_inflow_15m END AS x_lag1, CASE WHEN scenario_id % 9 = 0 THEN NULL ELSE lag(order_inflow_15m) OVER ({O}) END AS x_roll3_std FROM d)"


def gappy(spark, sf) -> DataFrame:
    x = F.col("order_inflow_15m")
    return panel(spark, sf).select("ID", "scenario_id", "timeslot", F.when((F.col("ID") % 3 == 0) | (F.col("ID") % 5 == 0), None).otherwise(x).alias("x_lag1"), F.when(F.col("scenario_id") % 9 == 0, None).otherwise(P.lag(x)).alias("x_roll3_std"))


def _filled(strategy):
    return lambda spark, sf: rounded(fill.fill(gappy(spark, sf), ["x_lag1", "x_roll3_std"], strategy, P), ["ID"], ["x_lag1", "x_roll3_std"])


_B, _A = f"OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_FB = lambda c: f"coalesce(last_value({c} IGNORE NULLS) {_B}, first_value({c} IGNORE NULLS) {_A}, -999)"
_SL = lambda c, x: f"last_value(CASE WHEN {c} IS NOT NULL THEN timeslot END IGNORE NULLS) {_B}" if x == 0 else f"first_value(CASE WHEN {c} IS NOT NULL THEN timeslot END IGNORE NULLS) {_A}"
_LERP = [f"l AS (SELECT ID, timeslot, " + ", ".join(f"{c}, last_value({c} IGNORE NULLS) {_B} AS {c}_v0, first_value({c} IGNORE NULLS) {_A} AS {c}_v1, {_SL(c, 0)} AS {c}_s0, {_SL(c, 1)} AS {c}_s1" for c in ("x_lag1", "x_roll3_std")) + " FROM m)", "f AS (SELECT ID, " + ", ".join(f"coalesce({c}, {c}_v0 + ({c}_v1 - {c}_v0) * (timeslot - {c}_s0) / nullif({c}_s1 - {c}_s0, 0), {c}_v0, {c}_v1, -999) AS {c}" for c in ("x_lag1", "x_roll3_std")) + " FROM l)"]
for _name, _strategy, _tables in (
    ("fill_ffill_bfill", "ffill_bfill", [f"f AS (SELECT ID, {_FB('x_lag1')} AS x_lag1, {_FB('x_roll3_std')} AS x_roll3_std FROM m)"]),
    ("fill_linear", "linear", _LERP),
    ("fill_std_zero", "roll_std_zero", ["f AS (SELECT ID, coalesce(x_lag1, -999) AS x_lag1, coalesce(x_roll3_std, 0) AS x_roll3_std FROM m)"]),
    ("fill_minus999", "minus999", ["f AS (SELECT ID, coalesce(x_lag1, -999) AS x_lag1, coalesce(x_roll3_std, -999) AS x_roll3_std FROM m)"]),
):
    QUERIES[_name] = _filled(_strategy)
    ORACLES[_name] = sql(pick(["x_lag1", "x_roll3_std"]), _GAPS, *_tables)


# ---- projections, joins, thresholds


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) AS price, coalesce(p_type, 'missing') AS p_type, round(l_extendedprice / (p_retailprice + 1e-6), 6) AS per_retail,
CAST(CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS INTEGER) AS is_large FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def dim_join_features(spark, sf):
    items, part = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("lineitem", "part"))
    joined = items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").join(part.select("p_partkey", "p_type", "p_retailprice", "p_size"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice", 2).alias("price"), F.coalesce("p_type", F.lit("missing")).alias("p_type"), F.round(safe_div(F.col("l_extendedprice"), F.col("p_retailprice")), 6).alias("per_retail"), flag(F.col("p_size") >= 25).alias("is_large"))


_LAYOUT_SQL = "lay AS (SELECT CAST(range AS BIGINT) AS layout_id, CASE WHEN range % 3 = 0 THEN 'hub_spoke' WHEN range % 3 = 1 THEN 'narrow' ELSE 'grid' END AS layout_type, 3e0 + range AS st, 10e0 + 3 * range AS rt, 2e0 + range AS ch FROM range(6))"


def layouts(spark) -> DataFrame:
    i = F.col("id")
    return spark.range(6).select(i.alias("layout_id"), F.when(i % 3 == 0, "hub_spoke").when(i % 3 == 1, "narrow").otherwise("grid").alias("layout_type"), (3.0 + i).alias("pack_station_count"), (10.0 + 3 * i).alias("robot_total"), (2.0 + i).alias("charger_count"))


@query(sql("SELECT ID AS id, round(st, 6) AS pack_station_count, round(rt, 6) AS robot_total, round(ch / (rt + 1e-6), 6) AS charger_per_robot, round(rt / (st + 1e-6), 6) AS robot_per_station, CAST(CASE WHEN lay.layout_id IS NULL THEN NULL WHEN layout_type = 'hub_spoke' THEN 1 ELSE 0 END AS DOUBLE) AS is_hub_spoke, CAST(CASE WHEN lay.layout_id IS NULL THEN NULL WHEN layout_type = 'narrow' THEN 1 ELSE 0 END AS DOUBLE) AS is_narrow FROM d LEFT JOIN lay ON d.layout_id = lay.layout_id", _LAYOUT_SQL))
def layout_join(spark, sf):
    joined = features.add_layout(panel(spark, sf).drop("pack_station_count", "robot_total"), layouts(spark))
    return rounded(joined, ["ID"], ["pack_station_count", "robot_total", "charger_per_robot", "robot_per_station", "is_hub_spoke", "is_narrow"])


_BN = {
    "pack_saturation": "CASE WHEN pack_utilization >= 0.95e0 THEN 1 ELSE 0 END", "pack_gap_to_full": "1 - pack_utilization", "order_per_pack_station": "oi / (st + 1e-6)", "available_robot": "ar", "available_robot_ratio": "ar / (robot_total + 1e-6)",
    "order_per_available_robot": "oi / (ar + 1e-6)", "idle_x_pack_utilization": "robot_idle * pack_utilization", "charging_ratio": "robot_charging / (robot_total + 1e-6)", "item_inflow_15m": "oi * avg_items_per_order",
    "sku_per_order": "unique_sku_15m / (oi + 1e-6)", "sku_pressure": "unique_sku_15m * oi", "heavy_item_pressure": "heavy_item_ratio * oi", "robot_shortage_ratio": "1 - ar / (robot_total + 1e-6)", "items_per_pack_station": "oi * avg_items_per_order / (st + 1e-6)",
    "heavy_order_per_pack_station": "oi * heavy_item_ratio / (st + 1e-6)", "sku_per_pack_station": "unique_sku_15m / (st + 1e-6)", "order_per_pack_x_pack_utilization": "oi / (st + 1e-6) * pack_utilization", "item_per_available_robot": "oi * avg_items_per_order / (ar + 1e-6)",
    "trip_pressure_per_available_robot": "avg_trip_distance * oi / (ar + 1e-6)", "congestion_x_avg_trip_distance": "congestion_score * avg_trip_distance",
}


@query(sql(pick(list(_BN)), "e AS (SELECT *, order_inflow_15m AS oi, pack_station_count AS st, robot_total - robot_charging AS ar FROM d)", "f AS (SELECT ID, " + ", ".join(f"{e} AS {n}" for n, e in _BN.items()) + " FROM e)"))
def bottleneck_features(spark, sf):
    return rounded(features.add_bottleneck(panel(spark, sf)), ["ID"], list(_BN))


@query(sql(pick(["timeslot_ratio", "remaining_slots", "late_congestion", "late_pack_pressure", "late_robot_idle"]), "f AS (SELECT ID, timeslot / 24e0 AS timeslot_ratio, 24 - timeslot AS remaining_slots, (24 - timeslot) * congestion_score AS late_congestion, (24 - timeslot) * pack_utilization AS late_pack_pressure, (24 - timeslot) * robot_idle AS late_robot_idle FROM d)"))
def late_pressure(spark, sf):
    return rounded(features.add_late_pressure(panel(spark, sf)), ["ID"], ["timeslot_ratio", "remaining_slots", "late_congestion", "late_pack_pressure", "late_robot_idle"])


@query(sql("SELECT id, round(list_avg(xs), 6) AS m, round(CASE WHEN len(xs) > 1 THEN list_stddev_samp(xs) END, 6) AS s, round(list_max(xs), 6) AS hi, round(list_min(xs), 6) AS lo FROM (SELECT ID AS id, list_filter([battery_mean, congestion_score, pack_utilization], lambda x: x IS NOT NULL) AS xs FROM d)"))
def row_stats(spark, sf):
    c = [F.col(n) for n in ("battery_mean", "congestion_score", "pack_utilization")]
    df = shown(panel(spark, sf), ["ID"], m=row_mean(*c), s=row_std(*c), hi=F.greatest(*c), lo=F.least(*c))
    return rounded(df, ["ID"], ["m", "s", "hi", "lo"])


_NFW = f"""w AS (SELECT *, avg(pack_utilization) {past(13)} AS p13, avg(pack_utilization) {past(20)} AS p20, avg(pack_utilization) {past(21)} AS p21, stddev_samp(pack_utilization) {past(13)} AS ps,
 avg(battery_mean) {past(21)} AS bm, stddev_samp(battery_mean) {past(21)} AS bs, robot_shortage_ratio * avg(congestion_score) {past(13)} AS r13, robot_shortage_ratio * avg(congestion_score) {past(20)} AS r20, robot_shortage_ratio * avg(congestion_score) {past(21)} AS r21 FROM b)"""
_NF1 = "n AS (SELECT *, list_filter([p13, p20, p21], lambda x: x IS NOT NULL) AS ps_, list_filter([r13, r20, r21], lambda x: x IS NOT NULL) AS rs_, bs / (abs(bm) + 1e-6) AS u FROM w)"
_NF2 = "n2 AS (SELECT *, list_avg(ps_) AS pm, CASE WHEN len(ps_) > 1 THEN list_stddev_samp(ps_) END AS pd, list_avg(rs_) AS rm, CASE WHEN len(rs_) > 1 THEN list_stddev_samp(rs_) END AS rd FROM n)"
_NQ = lambda c, q: _Q(c, q, "n")
_NF = {
    "nf_pack_long_mean_max": "greatest(p13, p20, p21)", "nf_pack_long_mean_gap": "greatest(p13, p20, p21) - least(p13, p20, p21)",
    "nf_pack_high_mean_and_volatility": f"CASE WHEN p13 >= {_NQ('p21', 0.8)} AND ps >= {_NQ('ps', 0.8)} THEN 1 ELSE 0 END", "nf_battery_roll21_instability": "u",
    "nf_battery_low_and_pack_high": f"CASE WHEN bm <= {_NQ('bm', 0.3)} AND p21 >= {_NQ('p21', 0.8)} THEN 1 ELSE 0 END", "nf_robot_cong_long_max": "greatest(r13, r20, r21)", "nf_robot_cong_long_mean": "rm",
    "nf_robot_cong_persistent_high": f"CASE WHEN r13 >= {_NQ('r13', 0.8)} AND r20 >= {_NQ('r20', 0.8)} AND r21 >= {_NQ('r21', 0.8)} THEN 1 ELSE 0 END", "nf_pack_robot_cong_pressure": "p21 * r21",
    "nf_pack_persistent_pressure": "round(pm / (pd + 1e-6), 2)", "nf_extra_pack_long_mean_avg": "pm", "nf_extra_pack_long_mean_std": "pd",
    "nf_extra_pack_high_count": " + ".join(f"CASE WHEN {p} >= {_NQ('p21', 0.85)} THEN 1 ELSE 0 END" for p in ("p13", "p20", "p21")), "nf_extra_robot_cong_long_std": "rd", "nf_extra_pack_x_robot_cong_mean": "pm * rm",
    "nf_extra_pack_high_robot_high": f"CASE WHEN pm >= {_NQ('p21', 0.85)} AND rm >= {_NQ('r21', 0.85)} THEN 1 ELSE 0 END", "nf_extra_battery_instab_high": f"CASE WHEN u >= {_NQ('u', 0.85)} THEN 1 ELSE 0 END",
    "nf_extra_pack_robot_battery_risk": f"CASE WHEN pm >= {_NQ('p21', 0.85)} AND rm >= {_NQ('r21', 0.85)} AND u >= {_NQ('u', 0.85)} THEN 1 ELSE 0 END",
}


@query(sql(pick(list(_NF)), _BOTTLE, _NFW, _NF1, _NF2, "f AS (SELECT ID, " + ", ".join(f"{e} AS {n}" for n, e in _NF.items()) + " FROM n2)"))
def neighbour_features(spark, sf):
    exact = BlockedPanel(P.entity, P.order)  # many windows have the same mean, so how it is rounded decides about flags
    df = features.add_rolling(features.add_bottleneck(exact.placed(panel(spark, sf))), exact, features.NEIGHBOUR_WINDOWS)
    made = features.add_neighbour(written(df.select("ID", "split", *features.neighbour_inputs()), "rolls"))  # thresholds and features read one table
    return rounded(made.withColumn("nf_pack_persistent_pressure", F.round("nf_pack_persistent_pressure", 2)), ["ID"], list(_NF))  # windows of equal means give large ratios


@query(sql("SELECT ID AS id, CAST(CASE WHEN order_inflow_15m >= (SELECT quantile_cont(order_inflow_15m, 0.8) FROM d WHERE split = 'train') THEN 1 ELSE 0 END AS INTEGER) AS over_q80 FROM d"))
def threshold_flags(spark, sf):
    df = panel(spark, sf)
    q = features.train_quantiles(df, {"q": (F.col("order_inflow_15m"), 0.8)})
    return features.with_scalars(df, q).select(F.col("ID").alias("id"), flag(F.col("order_inflow_15m") >= F.col("q")).alias("over_q80"))


# ---- bins and reports

_BIN = "CASE WHEN target <= 20 THEN 0 WHEN target <= 40 THEN 1 WHEN target <= 50 THEN 2 WHEN target <= 100 THEN 3 ELSE 4 END"
_FRAME = f"fr AS (SELECT ID, scenario_id, split, target, pred, pred2, abs(pred - target) AS abs_error, {_BIN} AS bin FROM p)"


def frame(spark, sf) -> DataFrame:
    return reports.prediction_frame(predicted(spark, sf), "target", "pred", group="scenario_id")


@query(sql("SELECT CAST(b.range AS INTEGER) AS bin, ['<20', '20-40', '40-50', '50-100', '100+'][b.range + 1] AS target_bin, CAST(count(fr.ID) AS BIGINT) AS count, round(avg(target), 6) AS target_mean, round(avg(pred), 6) AS pred_mean, round(avg(abs_error), 6) AS mae, round(max(pred), 6) AS pred_max, round(max(target), 6) AS target_max FROM range(5) b LEFT JOIN fr ON fr.bin = b.range GROUP BY b.range", _PRED, _FRAME))
def target_cut_report(spark, sf):
    got = reports.bin_report(frame(spark, sf))
    return got.select("bin", "target_bin", F.col("count").cast("long").alias("count"), *[F.round(c, 6).alias(c) for c in ("target_mean", "pred_mean", "mae", "pred_max", "target_max")])


@query(sql("SELECT ID AS id, CAST(CASE WHEN target < 10 THEN 0 WHEN target < 20 THEN 1 WHEN target < 30 THEN 2 WHEN target < 40 THEN 3 WHEN target < 50 THEN 4 WHEN target < 70 THEN 5 WHEN target < 100 THEN 6 WHEN target < 150 THEN 7 WHEN target < 300 THEN 8 ELSE 9 END AS INTEGER) AS wide_tail, CAST(CASE WHEN target < 10 THEN 0 WHEN target < 20 THEN 1 WHEN target < 30 THEN 2 WHEN target < 40 THEN 3 WHEN target < 50 THEN 4 WHEN target < 100 THEN 5 ELSE 6 END AS INTEGER) AS stable FROM d"))
def target_digitize(spark, sf):
    t = F.col("target")
    return panel(spark, sf).select(F.col("ID").alias("id"), features.digitise(t).cast("int").alias("wide_tail"), features.digitise(t, features.STABLE).cast("int").alias("stable"))


_SUMMARY = "CAST(count(*) AS BIGINT) AS n_rows, round(avg(abs_error), 6) AS mae, " + ", ".join(f"round(avg({c}), 6) AS {n}_mean, round(quantile_cont({c}, 0.5), 6) AS {n}_median, round(max({c}), 6) AS {n}_max" for n, c in (("target", "target"), ("pred", "pred"))) + ", " + ", ".join(f"round(quantile_cont(pred, 0.{q}), 6) AS pred_p{q}" for q in (90, 95, 99)) + ", " + ", ".join(f"CAST(count(*) FILTER (target >= {k}) AS BIGINT) AS high{k}_count, round(avg(CASE WHEN target >= {k} THEN 1e0 ELSE 0 END), 6) AS high{k}_ratio, round(avg(target) FILTER (target >= {k}), 6) AS high{k}_target_mean, round(avg(pred) FILTER (target >= {k}), 6) AS high{k}_pred_mean, round(avg(abs_error) FILTER (target >= {k}), 6) AS high{k}_mae" for k in (50, 100))


@query(sql(f"SELECT {_SUMMARY} FROM fr", _PRED, _FRAME))
def summary_report(spark, sf):
    got = reports.summary(frame(spark, sf))
    return got.select(*[F.col(c) if "count" in c or c == "n_rows" else F.round(c, 6).alias(c) for c in got.columns])


@query(sql('SELECT scenario_id AS "group", CAST(count(*) AS BIGINT) AS n_rows, round(avg(target), 6) AS target_mean, round(quantile_cont(target, 0.5), 6) AS target_median, max(target) AS target_max, round(coalesce(stddev_samp(target), 0), 6) AS target_std, ' + ", ".join(f"round(avg(CASE WHEN target >= {k} THEN 1e0 ELSE 0 END), 6) AS high{k}_ratio" for k in (50, 100, 200)) + " FROM d GROUP BY scenario_id"))
def scenario_stats(spark, sf):
    got = reports.group_statistics(panel(spark, sf), "scenario_id", "target")
    return got.select("group", "n_rows", "target_max", *[F.round(c, 6).alias(c) for c in ("target_mean", "target_median", "target_std", "high50_ratio", "high100_ratio", "high200_ratio")])


@query("SELECT p_type, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*)::DOUBLE FROM part WHERE p_type IS NOT NULL), 6) AS share FROM part WHERE p_type IS NOT NULL GROUP BY p_type")
def category_shares(spark, sf):
    return reports.shares(spark.read.parquet(f"{sf}/part.parquet"), "p_type").select("p_type", "n", F.round("share", 6).alias("share"))


@query(sql("SELECT d.ID AS id, round(coalesce(n / t, 0), 6) AS event_type_freq, " + ", ".join(f"CAST(CASE WHEN d.event_type = '{v}' THEN 1 ELSE 0 END AS INTEGER) AS event_type_oh_{v}" for v in ("click", "view")) + " FROM d LEFT JOIN (SELECT event_type, count(*)::DOUBLE AS n FROM d WHERE split = 'train' GROUP BY 1) USING (event_type), (SELECT count(*)::DOUBLE AS t FROM d WHERE split = 'train')"))
def category_onehot_freq(spark, sf):
    got = features.add_layout_encoding(panel(spark, sf), "event_type")
    one = lambda v: (F.col(f"event_type_oh_{v}") if f"event_type_oh_{v}" in got.columns else F.lit(0)).cast("int").alias(f"event_type_oh_{v}")
    return got.select(F.col("ID").alias("id"), F.round("event_type_freq", 6).alias("event_type_freq"), one("click"), one("view"))


@query(sql("SELECT CAST(count(target) AS BIGINT) AS count, round(avg(target), 6) AS mean, round(stddev_samp(target), 6) AS std, min(target) AS min, " + ", ".join(f"round(quantile_cont(target, {q}), 6) AS p{q * 100:g}" for q in (0.01, 0.05, 0.5, 0.95, 0.99)) + ", max(target) AS max FROM d"))
def describe_target(spark, sf):
    got = reports.describe(events(spark, sf).select(F.col("value").alias("target")), "target")
    return got.select("count", "min", "max", *[F.round(c, 6).alias(c) for c in got.columns if c not in ("count", "min", "max")])


@query(sql('SELECT CAST(c.range AS INTEGER) AS "class", CAST(count(d.ID) AS BIGINT) AS n, round(count(d.ID) / (SELECT count(*)::DOUBLE FROM d), 6) AS rate FROM range(12) c LEFT JOIN d ON d.ID % 9 = c.range GROUP BY c.range'))
def class_rate_report(spark, sf):
    return reports.class_rates(panel(spark, sf).withColumn("k", F.col("ID") % 9), "k", 12).select("class", F.col("n").cast("long").alias("n"), F.round("rate", 6).alias("rate"))


# ---- hygiene

_HC = ["battery_mean", "order_inflow_15m", "mostly", "same", "copy"]
_HSQL = "z AS (SELECT ID, battery_mean, order_inflow_15m, CASE WHEN ID % 50 = 0 THEN value ELSE NULL END AS mostly, 7 AS same, order_inflow_15m AS copy FROM (SELECT *, target AS value FROM d))"


def untidy(spark, sf) -> DataFrame:
    df = panel(spark, sf)
    return df.select("ID", "battery_mean", "order_inflow_15m", F.when(F.col("ID") % 50 == 0, F.col("target")).alias("mostly"), F.lit(7).alias("same"), F.col("order_inflow_15m").alias("copy"))


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1e0 ELSE 0 END), 6) AS share FROM z" for c in _HC), _HSQL))
def hygiene_missing(spark, sf):
    return hygiene.missing_shares(untidy(spark, sf), _HC).select("column", F.round("share", 6).alias("share"))


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST(count(*) AS BIGINT) AS n_distinct, round(max(n) / sum(n), 6) AS top_share FROM (SELECT {c}, count(*)::DOUBLE AS n FROM z GROUP BY {c})" for c in _HC), _HSQL))
def hygiene_constant(spark, sf):
    return hygiene.value_shares(untidy(spark, sf), _HC).select("column", "n_distinct", F.round("top_share", 6).alias("top_share"))


@query(sql(" UNION ALL ".join(f"SELECT '{b}' AS \"column\", '{a}' AS equals FROM z HAVING bool_and({a} IS NOT DISTINCT FROM {b})" for a, b in combinations(_HC, 2)), _HSQL))
def hygiene_duplicates(spark, sf):
    found = hygiene.duplicates(untidy(spark, sf), _HC, "ID")
    return spark.createDataFrame(sorted(found.items()), "column string, equals string")


# ---- ranking measures


@query("""WITH x AS (SELECT CAST(quality AS INTEGER) AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM x GROUP BY s),
h AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g)
SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(n) AS BIGINT) AS n_neg, round(sum(n * (tp - p + p / 2e0)) / (sum(p)::DOUBLE * sum(n)), 6) AS auc, round(sum(p * tp / (tp + fp)::DOUBLE) / sum(p), 6) AS average_precision FROM h""")
def auc_ap(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    got = reports.auc(rows, "quality", "n_chars")
    return got.select("n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query(sql("SELECT round(avg(CASE WHEN (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = y THEN 1e0 ELSE 0 END), 6) AS accuracy, round(-avg(ln(least(greatest(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END, 1e-7), 1 - 1e-7))), 6) AS log_loss FROM m", "m AS (SELECT ID % 3 AS y, (ID % 10) / 20e0 AS p0, (ID % 7) / 14e0 AS p1, 1 - (ID % 10) / 20e0 - (ID % 7) / 14e0 AS p2 FROM d)"))
def logloss_accuracy(spark, sf):
    i = F.col("ID")
    a, b = (i % 10) / 20.0, (i % 7) / 14.0
    got = reports.class_scores(panel(spark, sf).select((i % 3).alias("y"), F.array(a, b, 1 - a - b).alias("p")), "y", "p")
    return got.select(F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


@query(sql("SELECT ID AS id, round(p * 5 + (1 - p) * 0.25e0 * 60 + (1 - p) * 0.75e0 * 300, 6) AS expected_bin_mid, round((1 - p), 6) AS high_ge50, round((1 - p) * 0.75e0, 6) AS high_ge100 FROM (SELECT ID, (ID % 11) / 11e0 AS p FROM d)"))
def bin_probabilities(spark, sf):
    p = (F.col("ID") % 11) / 11.0
    parts = [p, *[F.lit(0.0)] * 4, (1 - p) * 0.25, *[F.lit(0.0)] * 3, (1 - p) * 0.75]
    named = features.bin_probability_features(F.array(*parts))
    return panel(spark, sf).select(F.col("ID").alias("id"), *[F.round(c, 6).alias(n) for n, c in named.items()])


@query(sql("SELECT ID AS id, round(p, 6) AS lt1_clf_prob_oof, round(p * p, 6) AS lt1_clf_prob_sq, CAST(CASE WHEN p >= 0.8e0 THEN 1 ELSE 0 END AS INTEGER) AS lt1_clf_prob_ge_0p8, CAST(CASE WHEN p >= 0.9e0 THEN 1 ELSE 0 END AS INTEGER) AS lt1_clf_prob_ge_0p9, CAST(CASE WHEN p >= 0.95e0 THEN 1 ELSE 0 END AS INTEGER) AS lt1_clf_prob_ge_0p95 FROM (SELECT d.ID, coalesce(q.p, 0e0) AS p FROM d LEFT JOIN (SELECT ID, (ID % 37) / 36e0 AS p FROM d WHERE ID % 4 <> 1) q ON d.ID = q.ID)"))
def low_probability_join(spark, sf):
    df = panel(spark, sf).select("ID")
    found = df.filter("ID % 4 <> 1").select("ID", ((F.col("ID") % 37) / 36.0).alias("p"))
    joined = df.join(found, "ID", "left")
    return joined.select(F.col("ID").alias("id"), *[(F.round(c, 6) if "_ge_" not in n else c).alias(n) for n, c in features.low_probability_features(F.col("p")).items()])


@query(sql("SELECT ID AS id, CAST(CASE WHEN target >= 100 THEN 8 WHEN target >= 50 THEN 4 WHEN target >= 40 THEN 2 ELSE 1 END AS DOUBLE) AS high, CAST(CASE WHEN target < 1 THEN 8 WHEN target < 10 THEN 4 WHEN target < 20 THEN 2 ELSE 1 END AS DOUBLE) AS low, CAST(CASE WHEN target >= 100 THEN 8 WHEN target >= 50 THEN 5 WHEN target >= 40 THEN 3 ELSE 1 END AS DOUBLE) AS delay, round(ln(1e0 + target), 6) AS log_target, CAST(CASE WHEN target < 1 THEN 1 ELSE 0 END AS INTEGER) AS lt1, CAST(CASE WHEN target >= 50 THEN 1 ELSE 0 END AS INTEGER) AS high50 FROM d"))
def sample_weights(spark, sf):
    t = F.col("target")
    y = features.labels(t)
    return panel(spark, sf).select(F.col("ID").alias("id"), blend.high_weight(t).alias("high"), blend.low_weight(t).alias("low"), blend.delay_weight(t).alias("delay"), F.round(features.to_log(t), 6).alias("log_target"), y["lt1"].alias("lt1"), y["high50"].alias("high50"))


# ---- splits


@query("""WITH RECURSIVE s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), o AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id DESC) AS i FROM s),
a(i, user_id, n, loads, fold) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0
 UNION ALL SELECT o.i, o.user_id, o.n, list_transform(a.loads, lambda x, k: CASE WHEN k = list_position(a.loads, list_min(a.loads)) THEN x + o.n ELSE x END), (list_position(a.loads, list_min(a.loads)) - 1)::INTEGER FROM a JOIN o ON o.i = a.i + 1)
SELECT CAST(fold AS INTEGER) AS fold, CAST(n AS BIGINT) AS group_size, CAST(count(*) AS BIGINT) AS n_groups FROM a WHERE i > 0 GROUP BY fold, n""")
def group_kfold(spark, sf):
    groups = split.group_kfold(panel(spark, sf), "scenario_id").groupBy("scenario_id", "fold").agg(F.count(F.lit(1)).alias("group_size"))
    return groups.groupBy("fold", "group_size").agg(F.count(F.lit(1)).alias("n_groups"))


@query("""WITH g AS (SELECT user_id AS scenario_id, avg(value) AS m, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id),
r AS (SELECT *, row_number() OVER (ORDER BY m DESC NULLS LAST, scenario_id) - 1 AS place, floor(count(*) OVER () * 0.2e0) AS fifth FROM g),
v AS (SELECT *, place < fifth AS high, floor(fifth * 0.3e0) AS n_high FROM r),
d AS (SELECT *, row_number() OVER (PARTITION BY high ORDER BY md5('42:' || scenario_id), scenario_id) - 1 AS nth FROM v)
SELECT scenario_id, nth < CASE WHEN high THEN n_high ELSE fifth - n_high END AS is_valid, n FROM d""")
def target_heavy_split(spark, sf):
    got = split.target_heavy_split(panel(spark, sf), "scenario_id", "target")
    return got.groupBy("scenario_id", "is_valid").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT CAST(scenario_id % 5 AS INTEGER) AS fold, CAST(count(*) AS BIGINT) AS n_valid, CAST(count(DISTINCT scenario_id) AS BIGINT) AS n_groups, round(avg(target), 6) AS valid_target_mean, max(target) AS valid_target_max, round(avg(pred), 6) AS pred_mean, round(max(pred), 6) AS pred_max, round(avg(abs_error), 6) AS mae FROM fr GROUP BY scenario_id % 5", _PRED, _FRAME))
def fold_report(spark, sf):
    got = reports.fold_report(predicted(spark, sf).withColumn("fold", (F.col("scenario_id") % 5).cast("int")), "fold", "scenario_id")
    return got.select("fold", "n_valid", "n_groups", "valid_target_max", *[F.round(c, 6).alias(c) for c in ("valid_target_mean", "pred_mean", "pred_max", "mae")])


@query(sql("SELECT round((SELECT avg(abs_error) FROM fr WHERE split = 'train'), 6) AS train_mae, round((SELECT avg(abs_error) FROM fr WHERE split = 'test'), 6) AS valid_mae, round((SELECT avg(abs_error) FROM fr WHERE split = 'test') - (SELECT avg(abs_error) FROM fr WHERE split = 'train'), 6) AS gap", _PRED, _FRAME))
def train_valid_gap(spark, sf):
    df = predicted(spark, sf).withColumn("abs_error", F.abs(F.col("pred") - F.col("target")))
    got = reports.mae_gap(df.filter("split = 'train'"), df.filter("split = 'test'"))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


# ---- blends and grids

_V = "CASE WHEN ID % 2 = 0 THEN 'groupkfold' ELSE 'holdout' END"


def validated(spark, sf) -> DataFrame:
    return predicted(spark, sf).withColumn("validation", F.expr(_V))


@query(sql("SELECT q_model, weight, round(avg(abs(target - greatest((1 - weight) * pred + weight * q, 0))) FILTER (v = 'groupkfold'), 6) AS groupkfold_mae, round(avg(abs(target - greatest((1 - weight) * pred + weight * q, 0))) FILTER (v = 'holdout'), 6) AS holdout_mae FROM (SELECT target, pred, " + _V + " AS v, unnest([{'q_model': 'ten', 'q': pred2}, {'q_model': 'order', 'q': order_inflow_15m / 2}], recursive := true) FROM p), (SELECT round(range * 0.025e0, 3) AS weight FROM range(25)) GROUP BY q_model, weight", _PRED))
def blend_grid_pivot(spark, sf):
    df = validated(spark, sf).withColumn("half", F.col("order_inflow_15m") / 2)
    got = blend.wide_grid(blend.weight_grid(df, {"ten": "pred2", "order": "half"}, "pred", "target", "validation"), "validation", ("groupkfold", "holdout"))
    return got.select("q_model", "weight", F.round("groupkfold_mae", 6).alias("groupkfold_mae"), F.round("holdout_mae", 6).alias("holdout_mae"))


_SMALL = {"high_base": (0.0, 0.05), "high50_coef": (0.0, 0.2), "high100_coef": (0.1,), "max_high": (0.25,), "low_coef": (0.0, 0.3), "max_low": (0.2,)}
_SP = "x AS (SELECT " + _V + " AS v, target, pred AS base, pred * 1.2e0 AS high, pred2 * 0.7e0 AS low, (ID % 13) / 13e0 AS p50, (ID % 17) / 17e0 AS p100, (ID % 5) / 5e0 AS pl FROM p)"


def specialists(spark, sf) -> DataFrame:
    i = F.col("ID")
    return validated(spark, sf).select("ID", "validation", "target", F.col("pred").alias("base"), (F.col("pred") * 1.2).alias("high"), (F.col("pred2") * 0.7).alias("low"), ((i % 13) / 13.0).alias("p50"), ((i % 17) / 17.0).alias("p100"), ((i % 5) / 5.0).alias("p_low"))


_NAMES = {k: k for k in ("base", "high", "low", "p50", "p100", "p_low", "target")}


@query(sql("SELECT v AS validation, hb AS high_base, h50 AS high50_coef, lc AS low_coef, round(avg(abs(target - greatest(base + least(greatest(hb + h50 * p50 + 0.1e0 * p100, 0), 0.25e0) * (high - base) + least(greatest(lc * pl, 0), 0.2e0) * (low - base), 0))), 6) AS mae FROM x, (SELECT unnest([0e0, 0.05e0]) AS hb), (SELECT unnest([0e0, 0.2e0]) AS h50), (SELECT unnest([0e0, 0.3e0]) AS lc) GROUP BY ALL", _PRED, _SP))
def specialist_grid_small(spark, sf):
    got = blend.specialist_grid(specialists(spark, sf), _NAMES, "validation", _SMALL)
    return got.select("validation", "high_base", "high50_coef", "low_coef", F.round("mae", 6).alias("mae"))


@query(sql(
    "SELECT * FROM (SELECT hb AS high_base, h50 AS high50_coef, h100 AS high100_coef, mh AS max_high, lc AS low_coef, ml AS max_low, round(avg(e) FILTER (v = 'groupkfold'), 6) AS groupkfold_mae, round(avg(e) FILTER (v = 'holdout'), 6) AS holdout_mae "
    "FROM (SELECT v, hb, h50, h100, mh, lc, ml, abs(target - greatest(base + hw * (high - base) + lw * (low - base), 0)) AS e FROM w, (SELECT unnest([0e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0]) AS lc), (SELECT unnest([0.1e0, 0.2e0, 0.3e0]) AS ml), LATERAL (SELECT least(greatest(lc * pl, 0), ml) AS lw)) "
    "GROUP BY hb, h50, h100, mh, lc, ml) ORDER BY groupkfold_mae, holdout_mae, high_base, high50_coef, high100_coef, max_high, low_coef, max_low LIMIT 20",
    _PRED, _SP, "w AS (SELECT v, target, base, high, low, pl, hb, h50, h100, mh, least(greatest(hb + h50 * p50 + h100 * p100, 0), mh) AS hw FROM x, (SELECT unnest([0e0, 0.025e0, 0.05e0, 0.075e0]) AS hb), (SELECT unnest([0e0, 0.05e0, 0.1e0, 0.2e0, 0.3e0]) AS h50), (SELECT unnest([0e0, 0.1e0, 0.2e0, 0.4e0, 0.6e0]) AS h100), (SELECT unnest([0.15e0, 0.25e0, 0.35e0, 0.45e0]) AS mh))",
))
def specialist_grid_topk(spark, sf):
    """The 20 best of all 6,000 combinations; errors are rounded before they are ranked, so that ties are told apart by the combination."""
    got = blend.specialist_grid(specialists(spark, sf), _NAMES, "validation").withColumn("mae", F.round("mae", 6))
    wide = blend.wide_grid(got, "validation", ("groupkfold", "holdout"))
    return blend.top(wide, 20, F.asc_nulls_last("groupkfold_mae"), F.asc_nulls_last("holdout_mae"), *blend.SPECIALIST_GRID)


@query(sql("SELECT ID AS id, round(greatest(pred + least(greatest(0.05e0 + 0.2e0 * (ID % 13) / 13e0 + 0.4e0 * (ID % 17) / 17e0, 0), 0.35e0) * (pred * 1.2e0 - pred) + least(greatest(0.3e0 * (ID % 5) / 5e0, 0), 0.3e0) * (pred2 * 0.7e0 - pred), 0), 6) AS blended FROM p", _PRED))
def specialist_blend(spark, sf):
    g = {"high_base": 0.05, "high50_coef": 0.2, "high100_coef": 0.4, "max_high": 0.35, "low_coef": 0.3, "max_low": 0.3}
    c = {k: F.col(k) for k in ("base", "high", "low", "p50", "p100", "p_low")}
    return specialists(spark, sf).select(F.col("ID").alias("id"), F.round(blend.specialist(c["base"], c["high"], c["low"], c["p50"], c["p100"], c["p_low"], g), 6).alias("blended"))


@query(sql("""SELECT round(w_best, 6) AS w_best, round(rem * wl / s, 6) AS w_lgbm, round(rem * wx / s, 6) AS w_xgb, round(rem * wc / s, 6) AS w_cat, round(avg(abs(target - (w_best * pred + rem * wl / s * pred2 + rem * wx / s * order_inflow_15m / 2 + rem * wc / s * battery))), 6) AS groupkfold_mae
FROM (SELECT *, coalesce(battery_mean, 0) AS battery FROM p), (SELECT *, 1 - w_best AS rem, wl + wx + wc AS s FROM (SELECT w_best, wl, wx, greatest(0, 1 - wl - wx) AS wc FROM (SELECT unnest([0.5e0, 0.6e0, 0.7e0, 0.8e0]) AS w_best), (SELECT unnest([0e0, 0.25e0, 0.34e0, 0.5e0]) AS wl), (SELECT unnest([0e0, 0.25e0, 0.33e0, 0.5e0]) AS wx))) GROUP BY w_best, rem, wl, wx, wc, s""", _PRED))
def ensemble_grid(spark, sf):
    df = predicted(spark, sf).select("target", "pred", "pred2", (F.col("order_inflow_15m") / 2).alias("half"), F.coalesce("battery_mean", F.lit(0.0)).alias("battery"))
    got = blend.ensemble_grid(df, "pred", "pred2", "half", "battery", "target")
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query(sql("SELECT ID AS id, round(greatest(CASE WHEN (ID % 10) / 10e0 >= 0.7e0 THEN 0.8e0 * pred - 1 ELSE pred END, 0), 6) AS adjusted FROM p", _PRED))
def lowdelay_post(spark, sf):
    return predicted(spark, sf).select(F.col("ID").alias("id"), F.round(blend.low_delay(F.col("pred"), (F.col("ID") % 10) / 10.0), 6).alias("adjusted"))


@query(sql("SELECT ID AS id, factor, round(pred * (1 + factor * (ID % 4) / greatest(max(ID % 4) OVER (PARTITION BY split), 1)), 6) AS adjusted FROM p, (SELECT unnest([0.005e0, 0.01e0, 0.015e0, 0.02e0, 0.03e0]) AS factor)", _PRED))
def risk_post(spark, sf):
    got = blend.risk_variants(predicted(spark, sf).withColumn("risk", F.col("ID") % 4), "pred", "risk", split="split")
    return got.select(F.col("ID").alias("id"), "factor", F.round("adjusted", 6).alias("adjusted"))


@query(sql("SELECT ID AS id, round(greatest((pred + pred2) / 2, 0), 6) AS mean_pred, round(greatest(0.675e0 * pred + 0.325e0 * pred2, 0), 6) AS blended FROM p", _PRED))
def constant_blend(spark, sf):
    df = predicted(spark, sf)
    return df.select(F.col("ID").alias("id"), F.round(blend.mean_of(F.col("pred"), F.col("pred2")), 6).alias("mean_pred"), F.round(blend.blend(F.col("pred"), F.col("pred2"), 0.325), 6).alias("blended"))


# ---- submissions and histories


@query(sql("SELECT d.ID AS id, round(a.pred, 6) AS a, round(b.pred2, 6) AS b FROM d LEFT JOIN (SELECT ID, pred FROM p WHERE ID % 3 <> 0) a ON a.ID = d.ID LEFT JOIN (SELECT ID, pred2 FROM p WHERE ID % 4 <> 0) b ON b.ID = d.ID", _PRED))
def submission_left_join(spark, sf):
    df = predicted(spark, sf)
    got = blend.assemble(df.select("ID"), {"a": df.filter("ID % 3 <> 0").select("ID", "pred"), "b": df.filter("ID % 4 <> 0").select("ID", F.col("pred2").alias("pred"))})
    return rounded(got, ["ID"], ["a", "b"])


@query(sql("SELECT CAST(bool_and(coalesce(x = y, x IS NULL AND y IS NULL)) AS INTEGER) AS exact_equal, CAST(bool_and(coalesce(abs(x - y) <= 1e-12, x IS NULL AND y IS NULL)) AS INTEGER) AS allclose_1e_12, round(max(abs(x - y)), 6) AS max_abs_diff, round(avg(abs(x - y)), 6) AS mean_abs_diff, CAST(count(*) FILTER (abs(x - y) > 1e-12) AS BIGINT) AS num_diff_gt_1e_12, round(avg(x), 6) AS reference_pred_mean, round(avg(y), 6) AS candidate_pred_mean FROM (SELECT a.pred AS x, b.pred2 AS y FROM (SELECT ID, pred FROM p WHERE ID % 5 <> 0) a FULL JOIN (SELECT ID, pred2 FROM p WHERE ID % 7 <> 0) b ON a.ID = b.ID)", _PRED))
def submission_compare(spark, sf):
    df = predicted(spark, sf)
    got = reports.compare(df.filter("ID % 5 <> 0").select("ID", "pred"), df.filter("ID % 7 <> 0").select("ID", F.col("pred2").alias("pred")), "pred")
    return got.select(*[F.round(c, 6).alias(c) if "diff" in c and "num" not in c or "mean" in c else F.col(c) for c in got.columns])


@query(sql("SELECT CAST(count(*) AS BIGINT) AS n_rows, round(avg(pred), 6) AS mean, round(quantile_cont(pred, 0.95), 6) AS p95, round(max(pred), 6) AS max FROM p", _PRED))
def submission_statistics(spark, sf):
    got = reports.submission_statistics(predicted(spark, sf), "pred")
    return got.select("n_rows", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "max")])


@query(sql("""SELECT CAST((SELECT count(*) FROM s) AS BIGINT) AS n_rows, CAST((SELECT count(*) FROM d) AS BIGINT) AS n_expected, CAST((SELECT count(*) FROM d WHERE ID NOT IN (SELECT ID FROM s)) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_extra,
CAST((SELECT count(*) FROM d WHERE ID % 100 = 1) AS BIGINT) AS n_repeated, CAST((SELECT count(*) FROM s WHERE pred IS NULL) AS BIGINT) AS n_null, CAST((SELECT count(*) FROM s WHERE pred < 0) AS BIGINT) AS n_negative""",
 "s AS (SELECT ID, CASE WHEN ID % 50 = 3 THEN NULL WHEN ID % 50 = 4 THEN -1e0 ELSE target END AS pred FROM (SELECT * FROM d WHERE ID % 10 <> 0 UNION ALL SELECT * FROM d WHERE ID % 100 = 1))"))
def submission_validate(spark, sf):
    df = panel(spark, sf)
    rows = df.filter("ID % 10 <> 0").unionByName(df.filter("ID % 100 = 1"))
    pred = F.when(F.col("ID") % 50 == 3, None).when(F.col("ID") % 50 == 4, -1.0).otherwise(F.col("target"))
    return validate.violations(rows.select("ID", pred.alias("pred")), df.select("ID"), "pred", order=None).drop("n_misplaced")


@query(sql("SELECT 'a' AS model, round(avg(abs_error), 6) AS mae, CAST(count(*) AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS extra FROM fr UNION ALL SELECT 'b', round(avg(abs(pred2 - target)), 6), NULL, round(max(pred2), 6) FROM fr", _PRED, _FRAME))
def report_union(spark, sf):
    df = predicted(spark, sf)
    a = df.agg(F.round(F.avg(F.abs(F.col("pred") - F.col("target"))), 6).alias("mae"), F.count(F.lit(1)).alias("n")).withColumn("model", F.lit("a"))
    b = df.agg(F.round(F.avg(F.abs(F.col("pred2") - F.col("target"))), 6).alias("mae"), F.round(F.max("pred2"), 6).alias("extra")).withColumn("model", F.lit("b"))
    return reports.union_reports(a, b).select("model", "mae", "n", "extra")


@query(sql("SELECT kind, k AS steps, mae FROM (SELECT 'roll' || (ID % 3) AS kind, CAST(ID % 12 AS INTEGER) AS k, round(min(target), 6) AS mae FROM d GROUP BY 1, 2) WHERE kind LIKE 'roll1%' ORDER BY mae, kind, k LIMIT 3"))
def history_topk(spark, sf):
    rows = panel(spark, sf).select(F.concat(F.lit("roll"), F.col("ID") % 3).alias("kind"), (F.col("ID") % 12).cast("int").alias("steps"), "target")
    best = rows.groupBy("kind", "steps").agg(F.round(F.min("target"), 6).alias("mae")).filter(F.col("kind").startswith("roll1"))
    return blend.top(best, 3, "mae", "kind", "steps")


@query(sql("SELECT CAST(count(*) FILTER (a IS NULL OR b IS NULL) AS BIGINT) AS n_unmatched, CAST(count(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND abs(a - b) > 1e-9) AS BIGINT) AS n_differ FROM (SELECT x.target AS a, y.t AS b FROM (SELECT ID, target FROM d WHERE ID % 6 <> 0) x FULL JOIN (SELECT ID, CASE WHEN ID % 9 = 0 THEN target + 1 ELSE target END AS t FROM d) y ON x.ID = y.ID)"))
def oof_consistency(spark, sf):
    df = panel(spark, sf).select("ID", "target")
    return blend.check_same_targets(df.filter("ID % 6 <> 0"), df.withColumn("target", F.when(F.col("ID") % 9 == 0, F.col("target") + 1).otherwise(F.col("target"))))


@query(sql("SELECT f AS feature, round(avg(g), 6) AS importance, CAST(count(*) AS BIGINT) AS n_folds FROM (SELECT 'f' || (ID % 40) AS f, ID % 5 AS k, max(target) AS g FROM d GROUP BY 1, 2) GROUP BY f"))
def feature_importance_report(spark, sf):
    rows = panel(spark, sf).groupBy(F.concat(F.lit("f"), F.col("ID") % 40).alias("feature"), (F.col("ID") % 5).alias("k")).agg(F.max("target").alias("importance"))
    return reports.importance(rows).withColumn("importance", F.round("importance", 6))


@query(sql("SELECT ID AS id, round(CASE WHEN isfinite(x) THEN x END, 6) AS x FROM (SELECT ID, CASE WHEN ID % 4 = 0 THEN 'NaN'::DOUBLE WHEN ID % 4 = 1 THEN 'Infinity'::DOUBLE WHEN ID % 4 = 2 THEN '-Infinity'::DOUBLE ELSE target END AS x FROM d)"))
def sanitised(spark, sf):
    i = F.col("ID") % 4
    x = F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, float("-inf")).otherwise(F.col("target"))
    return panel(spark, sf).select(F.col("ID").alias("id"), F.round(clean(x), 6).alias("x"))
