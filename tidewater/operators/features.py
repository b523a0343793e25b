"""Feature layers of the dispatch-delay panel. Each adds its columns in as few projections as their dependence allows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidewater.functions.nulls import EPSILON, col_or, dot, flag, floor_at, row_max, row_mean, row_min, row_std, safe_div, zero
from tidewater.operators.panel import Panel
from tidewater.operators.quantiles import exact_quantiles
from tidewater.registry import Feature, lineage

SCENARIO = Panel("scenario_id", ("ID",))

# Columns, steps and windows of the feature set.
ROLL_COLUMNS = ("order_inflow_15m", "battery_mean", "congestion_score", "pack_utilization", "backorder_ratio")
LAG_COLUMNS = ("battery_mean", "low_battery_ratio", "order_inflow_15m", "robot_utilization", "robot_charging", "congestion_score")
LAG_STEPS = tuple(range(1, 11))
DIFF_STEPS = (1, 2, 3, 5, 10)
WINDOWS = tuple(range(2, 25))
CUMSUM_COLUMNS = ("order_inflow_15m", "congestion_score", "pack_utilization", "backorder_ratio")
DECAY_COLUMNS = (*CUMSUM_COLUMNS, "order_per_pack_station")
DECAYS = (0.7, 0.85, 0.95)
SLOPE_COLUMNS = ("congestion_score", "pack_utilization", "order_inflow_15m", "backorder_ratio")
STATE_WINDOWS = (5, 10, 15, 24)
CONTEXT_WINDOWS = (19, 20, 25)
NEIGHBOUR_WINDOWS = (13, 20, 21)
RANK_COLUMNS = (
    "order_inflow_15m", "unique_sku_15m", "urgent_order_ratio", "robot_idle", "robot_utilization", "robot_charging", "battery_mean", "low_battery_ratio",
    "charge_queue_length", "avg_charge_wait", "congestion_score", "blocked_path_15m", "near_collision_15m", "pack_utilization", "loading_dock_util", "outbound_truck_wait_min",
)
FAMILY_COLUMNS = ("bp_pack_overload", "bp_robot_overload", "bp_demand_capacity_pressure", "bp_congestion_order_pressure", "bp_downstream_pressure")

# Columns that get rolling context beside the base prediction, and beginnings of names of further ones.
CONTEXT_COLUMNS = (
    "sc_pred_rank", "sc_pred_relmean", "sc_pred_z", "sc_pred_to_p90", "sc_pred_to_p75", "sc_pred_to_max", "sc_pred_rank_x_pred",
    "bp_pack_overload", "bp_robot_overload", "bp_demand_capacity_pressure", "bp_downstream_pressure", "bp_congestion_order_pressure", "bp_congestion_pack_overload",
    "bp_battery_robot_overload", "bp_backorder_pack_pressure", "bp_order_pack_capacity_gap", "bp_order_robot_capacity_gap", "bp_robot_available_gap",
)
CONTEXT_FAMILIES = ("sc_rank_", "sc_z_", "sc_relmean_", "sc_to_max_", "sc_range_pos_")


def with_named(df: DataFrame, columns: dict[str, Column], kind: str | None = None, about: dict[str, Feature] | None = None) -> DataFrame:
    """df with columns added in one projection; earlier ones of the same name are replaced.

    kind: what all of them are; about: what each is. It goes into their metadata.
    """
    told = about or ({n: Feature(n, kind) for n in columns} if kind else {})
    return df.select(*[c for c in df.columns if c not in columns], *[told[n].label(c) if n in told else c.alias(n) for n, c in columns.items()])


def with_features(df: DataFrame, made: dict[Feature, Column]) -> DataFrame:
    return with_named(df, {f.name: c for f, c in made.items()}, about={f.name: f for f in made})


def add_layout(df: DataFrame, layout: DataFrame) -> DataFrame:
    """Join layouts (one row each; many rows of df to one) and derive capacities and types."""
    kind = F.col("layout_type")
    made = {
        "pack_station_count": F.col("pack_station_count"),
        "robot_total": F.col("robot_total"),
        "charger_per_robot": safe_div(F.col("charger_count"), F.col("robot_total")),
        "robot_per_station": safe_div(F.col("robot_total"), F.col("pack_station_count")),
        "is_hub_spoke": flag(kind == "hub_spoke"),
        "is_narrow": flag(kind == "narrow"),
    }
    derived = layout.select("layout_id", *[Feature(n, "layout").label(c) for n, c in made.items()])
    return df.join(derived, "layout_id", "left")


def add_bottleneck(df: DataFrame) -> DataFrame:
    """Ratios, products and gaps of inflow, stations and robots."""
    oi, stations, pack = F.col("order_inflow_15m"), F.col("pack_station_count"), F.col("pack_utilization")
    robots = F.col("robot_total") - F.col("robot_charging")
    share, heavy, items = safe_div(robots, F.col("robot_total")), F.col("heavy_item_ratio"), F.col("avg_items_per_order")
    sku, trip = F.col("unique_sku_15m"), F.col("avg_trip_distance")
    return with_named(df, {
        "pack_saturation": flag(pack >= 0.95),
        "pack_gap_to_full": 1 - pack,
        "order_per_pack_station": safe_div(oi, stations),
        "available_robot": robots,
        "available_robot_ratio": share,
        "order_per_available_robot": safe_div(oi, robots),
        "idle_x_pack_utilization": F.col("robot_idle") * pack,
        "charging_ratio": safe_div(F.col("robot_charging"), F.col("robot_total")),
        "item_inflow_15m": oi * items,
        "sku_per_order": safe_div(sku, oi),
        "sku_pressure": sku * oi,
        "heavy_item_pressure": heavy * oi,
        "robot_shortage_ratio": 1 - share,
        "items_per_pack_station": safe_div(oi * items, stations),
        "heavy_order_per_pack_station": safe_div(oi * heavy, stations),
        "sku_per_pack_station": safe_div(sku, stations),
        "order_per_pack_x_pack_utilization": safe_div(oi, stations) * pack,
        "item_per_available_robot": safe_div(oi * items, robots),
        "trip_pressure_per_available_robot": safe_div(trip * oi, robots),
        "congestion_x_avg_trip_distance": F.col("congestion_score") * trip,
    }, "bottleneck")


def add_lags(df: DataFrame, panel: Panel = SCENARIO, columns: Sequence[str] = LAG_COLUMNS, lags: Iterable[int] = LAG_STEPS, diffs: Iterable[int] = DIFF_STEPS) -> DataFrame:
    lags, diffs = tuple(lags), tuple(diffs)
    made = {Feature(f"{c}_lag{k}", "lag", c, k): panel.lag(c, k) for c in columns for k in lags}
    made |= {Feature(f"{c}_diff{k}", "diff", c, k): panel.diff(c, k) for c in columns for k in diffs}
    return with_features(df, made)


def add_rolling(df: DataFrame, panel: Panel = SCENARIO, windows: Iterable[int] = WINDOWS, columns: Sequence[str] = ROLL_COLUMNS, interactions: bool = True) -> DataFrame:
    """mean, max and std of the rows before for each window, and what they give with the current row."""
    made: dict[Feature, Column] = {}
    for n in windows:
        made |= {Feature(f"{c}_roll{n}_{how}", "roll", c, n, how): panel.roll(c, n, how) for c in columns for how in ("mean", "max", "std")}
        if interactions:
            cong, pack, order, opp = (panel.roll(c, n, "mean") for c in ("congestion_score", "pack_utilization", "order_inflow_15m", "order_per_pack_station"))
            of = lambda name, base, how, n=n: Feature(name, "roll", base, n, how)
            made |= {
                of(f"congestion_vs_roll{n}", "congestion_score", "vs"): F.col("congestion_score") - cong,
                of(f"congestion_roll{n}_x_pack", "congestion_score", "product"): cong * F.col("pack_utilization"),
                of(f"robot_shortage_x_congestion_roll{n}", "congestion_score", "product"): F.col("robot_shortage_ratio") * cong,
                of(f"pack_utilization_vs_roll{n}", "pack_utilization", "vs"): F.col("pack_utilization") - pack,
                of(f"order_per_pack_station_roll{n}_mean", "order_per_pack_station", "mean"): opp,
                of(f"order_per_pack_station_roll{n}_max", "order_per_pack_station", "max"): panel.roll("order_per_pack_station", n, "max"),
                of(f"order_per_pack_station_vs_roll{n}", "order_per_pack_station", "vs"): F.col("order_per_pack_station") - opp,
                of(f"order_roll{n}_per_pack_station", "order_inflow_15m", "ratio"): safe_div(order, F.col("pack_station_count")),
            }
    return with_features(df, made)


def add_cumsum(df: DataFrame, panel: Panel = SCENARIO, columns: Sequence[str] = CUMSUM_COLUMNS) -> DataFrame:
    return with_features(df, {Feature(f"{c}_cumsum", "cumsum", c): panel.cumulative_sum(c) for c in columns})


def add_decay(df: DataFrame, panel: Panel = SCENARIO, columns: Sequence[str] = DECAY_COLUMNS, decays: Sequence[float] = DECAYS) -> DataFrame:
    return with_features(df, {Feature(f"{c}_decay{str(d).replace('.', '')}", "decay", c, how=str(d)): panel.ewm(c, d) for c in columns for d in decays})


def add_slope(df: DataFrame, panel: Panel = SCENARIO, columns: Sequence[str] = SLOPE_COLUMNS) -> DataFrame:
    return with_features(df, {Feature(f"{c}_slope5", "slope", c, 5): panel.slope(c, 5) for c in columns})


def states() -> dict[str, Column]:
    return {
        "congestion_high": F.col("congestion_score") > 0.8,
        "pack_high": F.col("pack_utilization") > 0.9,
        "backorder_high": F.col("backorder_ratio") > 0,
        "robot_shortage_high": F.col("robot_shortage_ratio") > 0.2,
    }


def add_persistence(df: DataFrame, panel: Panel = SCENARIO) -> DataFrame:
    """Length of the current run, and counts and upward crossings in recent rows, of four states."""
    conditions = states()
    out = panel.add_runs(df, {f"{n}_run_length": c for n, c in conditions.items()})
    out = with_features(out, {Feature(f"{n}_count_roll{w}", "persistence", n, w, "count"): panel.state_count(c, w) for n, c in conditions.items() for w in STATE_WINDOWS})
    out = panel.add_crossings(out, {n: (c, {f"{n}_cross_roll{w}": w for w in STATE_WINDOWS}) for n, c in conditions.items()})
    told = {f"{n}_run_length": Feature(f"{n}_run_length", "persistence", n, how="run") for n in conditions}
    told |= {f"{n}_cross_roll{w}": Feature(f"{n}_cross_roll{w}", "persistence", n, w, "crossings") for n in conditions for w in STATE_WINDOWS}
    return out.select(*[told[c].label(F.col(c)) if c in told else c for c in out.columns])


def add_late_pressure(df: DataFrame, slots: int = 24) -> DataFrame:
    left = slots - F.col("timeslot")
    return with_named(df, {
        "timeslot_ratio": F.col("timeslot") / slots,
        "remaining_slots": left,
        "late_congestion": left * F.col("congestion_score"),
        "late_pack_pressure": left * F.col("pack_utilization"),
        "late_robot_idle": left * F.col("robot_idle"),
    }, "late")


def train_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, float]], split: str = "split") -> DataFrame:
    """One row of exact quantiles over the training rows."""
    values = {str(c): c for c, _ in wanted.values()}
    return exact_quantiles(df.filter(F.col(split) == "train"), values, {n: (str(c), q) for n, (c, q) in wanted.items()})


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """df beside a frame of exactly one row."""
    return df.crossJoin(F.broadcast(scalars))


def add_scenario_risk(df: DataFrame, panel: Panel = SCENARIO) -> DataFrame:
    """What a scenario has shown so far, against quantiles of the training rows."""
    c = {"congestion": "congestion_score", "pack": "pack_utilization", "order": "order_inflow_15m", "robot_shortage": "robot_shortage_ratio"}
    limits = train_quantiles(df, {f"_q_{n}": (F.col(x), 0.8) for n, x in c.items()})
    so_far = with_named(df, {
        "sc_congestion_mean_so_far": panel.expanding("congestion_score", "mean"),
        "sc_congestion_max_so_far": panel.expanding("congestion_score", "max"),
        "sc_pack_mean_so_far": panel.expanding("pack_utilization", "mean"),
        "sc_backorder_max_so_far": panel.expanding("backorder_ratio", "max"),
        "sc_order_sum_so_far": panel.cumulative_sum("order_inflow_15m"),
        "sc_order_mean_so_far": panel.expanding("order_inflow_15m", "mean"),
        "sc_robot_shortage_mean_so_far": panel.expanding("robot_shortage_ratio", "mean"),
    }, "scenario")
    over = {"congestion": "congestion_max", "pack": "pack_mean", "order": "order_mean", "robot_shortage": "robot_shortage_mean"}
    risk = flag(F.col("sc_backorder_max_so_far") > 0)
    for n, x in over.items():
        risk = risk + flag(F.col(f"sc_{x}_so_far") >= F.col(f"_q_{n}"))
    counted = with_named(with_scalars(so_far, limits), {"sc_risk_count_so_far": risk}, "scenario").drop(*[f"_q_{n}" for n in c])
    return with_named(counted, {"late16_sc_risk_count": flag(F.col("timeslot") >= 16) * F.col("sc_risk_count_so_far")}, "scenario")


def add_first4(df: DataFrame, panel: Panel = SCENARIO) -> DataFrame:
    specs = {"congestion_mean": ("congestion_score", "mean"), "pack_mean": ("pack_utilization", "mean"), "order_mean": ("order_inflow_15m", "mean"), "backorder_max": ("backorder_ratio", "max"), "robot_shortage_mean": ("robot_shortage_ratio", "mean")}
    out = with_features(df, {Feature(f"first4_{n}", "first4", c, how=how): panel.first_n(c, how) for n, (c, how) in specs.items()})
    return with_named(out, {f"first4_{n}_late16": F.col(f"first4_{n}") * flag(F.col("timeslot") >= 16) for n in specs}, "first4")


def add_backlog(df: DataFrame, panel: Panel = SCENARIO, split: str = "split") -> DataFrame:
    """Gaps between demand and capacity, pressures, and what they add up to over a scenario.

    Waiting lines are scaled by the median size within their own split.
    """
    waits = ("label_print_queue", "outbound_truck_wait_min", "charge_queue_length")
    sizes = {w: F.abs(col_or(df, w).cast("double")) for w in waits}
    medians = exact_quantiles(df, sizes, {f"_m_{w}": (w, 0.5) for w in waits}, [split])
    both = df.join(F.broadcast(medians), split, "left")  # a row for each split
    get = lambda n: col_or(df, n)
    scaled = {w: get(w) / (F.abs(F.col(f"_m_{w}")) + EPSILON) for w in waits}
    oi, stations, active, pack = get("order_inflow_15m"), get("pack_station_count"), get("robot_active"), get("pack_utilization")
    pack_gap = oi - stations * (1 - pack)
    robot_gap = oi - active * (1 - get("robot_utilization"))
    demand = oi / (stations + active + EPSILON)
    cong = get("congestion_score")
    base = with_named(both, {
        "bp_order_pack_capacity_gap": pack_gap,
        "bp_order_robot_capacity_gap": robot_gap,
        "bp_robot_available_gap": get("robot_total") - active - get("robot_charging"),
        "bp_pack_overload": floor_at(pack_gap),
        "bp_robot_overload": floor_at(robot_gap),
        "bp_demand_capacity_pressure": demand,
        "bp_downstream_pressure": (pack + get("loading_dock_util") + scaled["label_print_queue"] + scaled["outbound_truck_wait_min"]) / 4,
        "bp_congestion_order_pressure": cong * demand,
        "bp_congestion_pack_overload": cong * floor_at(pack_gap),
        "bp_battery_robot_overload": (get("low_battery_ratio") + scaled["charge_queue_length"]) * floor_at(robot_gap),
        "bp_backorder_pack_pressure": get("backorder_ratio") * floor_at(pack_gap),
    }, "backlog").drop(*[f"_m_{w}" for w in waits])
    out = with_named(base, {f"{c}_{n}": x for c in FAMILY_COLUMNS for n, x in panel.cumulative_family(c).items()}, "backlog")
    pairs = {"congestion_score": "bp_congestion_order_pressure", "pack_utilization": "bp_pack_overload", "order_inflow_15m": "bp_demand_capacity_pressure", "low_battery_ratio": "bp_robot_overload"}
    return with_named(out, {f"bp_{raw}_diff1_x_{c}_cumsum_prev": zero(panel.diff(raw)) * F.col(f"{c}_cumsum_prev") for raw, c in pairs.items() if raw in df.columns}, "backlog")


def neighbour_inputs() -> list[str]:
    """The rolls that add_neighbour reads."""
    rolls = [f"{c}{n}{end}" for c, end in (("pack_utilization_roll", "_mean"), ("robot_shortage_x_congestion_roll", "")) for n in NEIGHBOUR_WINDOWS]
    return [*rolls, "pack_utilization_roll13_std", "battery_mean_roll21_mean", "battery_mean_roll21_std"]


def add_neighbour(df: DataFrame) -> DataFrame:
    """How long windows agree with each other, and joint flags against quantiles of the training rows.

    df is read once for the quantiles and once for the features: pass a written table, so that its rolls aren't computed twice.
    """
    p = [F.col(f"pack_utilization_roll{n}_mean") for n in NEIGHBOUR_WINDOWS]
    r = [F.col(f"robot_shortage_x_congestion_roll{n}") for n in NEIGHBOUR_WINDOWS]
    p13_std, b, b_std = F.col("pack_utilization_roll13_std"), F.col("battery_mean_roll21_mean"), F.col("battery_mean_roll21_std")
    unrest = b_std / (F.abs(b) + EPSILON)
    limits = train_quantiles(df, {
        "_p80": (p[2], 0.8), "_p13s80": (p13_std, 0.8), "_b30": (b, 0.3), "_r13": (r[0], 0.8), "_r20": (r[1], 0.8), "_r21": (r[2], 0.8),
        "_p85": (p[2], 0.85), "_r85": (r[2], 0.85), "_u85": (unrest, 0.85),
    })
    high = (row_mean(*p) >= F.col("_p85")) & (row_mean(*r) >= F.col("_r85"))
    return with_named(with_scalars(df, limits), {
        "nf_pack_long_mean_max": row_max(*p),
        "nf_pack_long_mean_gap": row_max(*p) - row_min(*p),
        "nf_pack_high_mean_and_volatility": flag((p[0] >= F.col("_p80")) & (p13_std >= F.col("_p13s80"))),
        "nf_battery_roll21_instability": unrest,
        "nf_battery_low_and_pack_high": flag((b <= F.col("_b30")) & (p[2] >= F.col("_p80"))),
        "nf_robot_cong_long_max": row_max(*r),
        "nf_robot_cong_long_mean": row_mean(*r),
        "nf_robot_cong_persistent_high": flag((r[0] >= F.col("_r13")) & (r[1] >= F.col("_r20")) & (r[2] >= F.col("_r21"))),
        "nf_pack_robot_cong_pressure": p[2] * r[2],
        "nf_pack_persistent_pressure": row_mean(*p) / (row_std(*p) + EPSILON),
        "nf_extra_pack_long_mean_avg": row_mean(*p),
        "nf_extra_pack_long_mean_std": row_std(*p),
        "nf_extra_pack_high_count": flag(p[0] >= F.col("_p85")) + flag(p[1] >= F.col("_p85")) + flag(p[2] >= F.col("_p85")),
        "nf_extra_robot_cong_long_std": row_std(*r),
        "nf_extra_pack_x_robot_cong_mean": row_mean(*p) * row_mean(*r),
        "nf_extra_pack_high_robot_high": flag(high),
        "nf_extra_battery_instab_high": flag(unrest >= F.col("_u85")),
        "nf_extra_pack_robot_battery_risk": flag(high & (unrest >= F.col("_u85"))),
    }, "neighbour").drop(*limits.columns)


def add_scenario_rank(df: DataFrame, panel: Panel = SCENARIO, columns: Sequence[str] = RANK_COLUMNS) -> DataFrame:
    """Each value's rank and place within its whole scenario; absent columns are skipped."""
    there = [c for c in columns if c in df.columns]
    made = {Feature(f"sc_rank_{c}", "rank", c, how="rank"): panel.rank_pct(c) for c in there}
    return with_features(df, made | {Feature(f"sc_{n}_{c}", "rank", c, how=n): x for c in there for n, x in panel.relative(c).items()})


def add_prediction_context(df: DataFrame, prediction: str, panel: Panel = SCENARIO) -> DataFrame:
    p, own = F.col(prediction), panel.relative(prediction)
    out = with_named(df, {
        "sc_pred_rank": panel.rank_pct(prediction),
        "sc_pred_relmean": own["relmean"],
        "sc_pred_z": own["z"],
        "sc_pred_to_max": own["to_max"],
        "sc_pred_mean": F.avg(prediction).over(panel.group),
        "sc_pred_p75": panel.quantile(prediction, 0.75),
        "sc_pred_p90": panel.quantile(prediction, 0.9),
        "sc_pred_max": F.max(prediction).over(panel.group),
    }, "prediction")
    return with_named(out, {
        "sc_pred_to_p90": p / (F.abs("sc_pred_p90") + EPSILON),
        "sc_pred_to_p75": p / (F.abs("sc_pred_p75") + EPSILON),
        "sc_pred_rank_x_pred": F.col("sc_pred_rank") * p,
    }, "prediction")


def context_columns(df: DataFrame, prediction: str) -> list[str]:
    """The columns of df that change within a scenario and get rolling context: up to 99 with all ranks."""
    known = lineage(df)
    families = [c for c in df.columns if c.startswith(CONTEXT_FAMILIES) and not (c in known and known[c].kind == "context")]
    return [c for c in dict.fromkeys([prediction, *CONTEXT_COLUMNS, *families]) if c in df.columns]


def add_context_rolling(df: DataFrame, columns: Sequence[str], panel: Panel = SCENARIO, windows: Sequence[int] = CONTEXT_WINDOWS, layer: int = 200) -> DataFrame:
    """Rolling statistics of many columns, in layers of so many expressions that plans stay readable."""
    made: dict[Feature, Column] = {}
    for c in columns:
        for n in windows:
            found = panel.context(c, n)
            made |= {Feature(f"{c}_ctxroll{n}_{k}", "context", c, n, k): found[k] for k in ("mean", "max", "std")}
            made[Feature(f"{c}_vs_ctxroll{n}_mean", "context", c, n, "vs")] = found["vs_mean"]
    items = list(made.items())
    for at in range(0, len(items), layer):
        df = with_features(df, dict(items[at : at + layer]))
    return df


def add_layout_encoding(df: DataFrame, column: str = "layout_type", split: str = "split", most: int = 1000) -> DataFrame:
    """Share of each category among the training rows (unseen: 0) and a 0/1 column for each category of either split.

    Categories whose names differ in signs or case alone get numbered columns. More than `most` categories raise an error.
    """
    kind = F.coalesce(F.col(column).cast("string"), F.lit("missing"))
    named = df.withColumn(column, kind)
    train = named.filter(F.col(split) == "train")
    shares = train.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = train.agg(F.count(F.lit(1)).alias("_all"))
    shares = with_scalars(shares, total).select(column, (F.col("_n") / F.col("_all")).alias(f"{column}_freq"))
    categories = sorted(r[0] for r in named.select(column).distinct().take(most + 1))  # columns are made of them
    if len(categories) > most:
        raise ValueError(f"{column} has more than {most} categories")
    placed = named.join(shares, column, "left")
    out = with_named(placed, {f"{column}_freq": zero(F.col(f"{column}_freq"))}, "category")
    safe: dict[str, str] = {}
    for c in categories:
        name = "".join(x if x.isalnum() else "_" for x in c.lower())
        same = sum(s == name or s.startswith(f"{name}__") for s in safe.values())
        safe[c] = f"{name}__{same + 1}" if same else name
    return with_named(out, {f"{column}_oh_{safe[c]}": (F.col(column) == c).cast("byte") for c in categories}, "category")


# Edges of the delay bins.
WIDE_TAIL = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 70.0, 100.0, 150.0, 300.0, float("inf"))
STABLE = (0.0, 10.0, 20.0, 30.0, 40.0, 50.0, 100.0, float("inf"))


def digitise(c: Column, edges: Sequence[float] = WIDE_TAIL) -> Column:
    """Number of the bin that holds c; bins are closed on the left and lower values count as the first edge."""
    out = F.lit(0)
    for i, e in enumerate(edges[1:-1], 1):
        out = F.when(c >= e, F.lit(i)).otherwise(out)
    return F.when(c.isNotNull(), out).cast("short")


def bin_labels(edges: Sequence[float]) -> list[str]:
    name = lambda e: "inf" if e == float("inf") else str(int(e))
    return [f"bin_{name(a)}_{name(b)}" for a, b in zip(edges, edges[1:])]


def aligned_probabilities(found: Column, classes: int) -> Column:
    """A map of class to probability as an array over all classes; absent classes are 0."""
    return F.array(*[zero(F.try_element_at(found, F.lit(k))) for k in range(classes)])


def bin_probability_features(probabilities: Column, edges: Sequence[float] = WIDE_TAIL) -> dict[str, Column]:
    """Expected middle (the last bin counts with its lower edge) and the mass of bins from 50 and from 100 on."""
    mids = [a if b == float("inf") else (a + b) / 2 for a, b in zip(edges, edges[1:])]
    return {
        "expected_bin_mid": dot(probabilities, mids),
        "high_ge50": dot(probabilities, [float(a >= 50) for a in edges[:-1]]),
        "high_ge100": dot(probabilities, [float(a >= 100) for a in edges[:-1]]),
    }


def bin_features(probabilities: Column, edges: Sequence[float], name: str) -> dict[str, Column]:
    """The probability of each bin, and what bin_probability_features makes of them; missing probabilities count as 0."""
    each = {f"{name}_{label}": zero(F.get(probabilities, F.lit(i))) for i, label in enumerate(bin_labels(edges))}
    return each | {f"{name}_{n}": zero(c) for n, c in bin_probability_features(probabilities, edges).items()}


def low_probability_features(p: Column, name: str = "lt1_clf_prob") -> dict[str, Column]:
    p = zero(p)
    return {f"{name}_oof": p, f"{name}_sq": p * p} | {f"{name}_ge_{str(q).replace('.', 'p')}": flag(p >= q) for q in (0.8, 0.9, 0.95)}


def to_log(c: Column) -> Column:
    return F.log1p(c)


def from_log(c: Column) -> Column:
    """The inverse of to_log, not below 0."""
    return floor_at(F.expm1(c))


def labels(target: Column) -> dict[str, Column]:
    return {"lt1": flag(target < 1), "high50": flag(target >= 50), "high100": flag(target >= 100)}

