"""Exact quantiles of columns of any length: no task and no driver holds a column's distinct values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.functions.moments import fma
from tidewater.operators.ranks import free_name
from tidewater.sources.shared import drop_written, written

#: Values that may be left between the bounds of a quantile before they are ordered.
MOST_LEFT = 100_000
#: Steps of the grid that bounds are taken from, and its relative accuracy (far finer than a step).
STEPS, ACCURACY = 100, 10_000


@dataclass
class _Sought:
    """A quantile of one group: its place among n values, bounds, and how many values lie below and between them."""

    group: int
    column: int
    name: str
    at: float
    low: float
    high: float
    below: int
    within: int

    def holds(self, below: int, within: int) -> bool:
        return below <= floor(self.at) and ceil(self.at) < below + within

    def narrower(self, grid: Sequence[float]) -> tuple[float, float]:
        step = (self.at - self.below) / self.within * STEPS
        low, high = floor(step) - 1, ceil(step) + 1
        return self.low if low < 0 else grid[low], self.high if high > STEPS else grid[high]


def between(low: Column, high: Column, part: Column) -> Column:
    """The value at a part of the way from low to high, with the bits that DuckDB gives it: windows of equal means are held against it."""
    near = F.greatest(F.abs(low), F.abs(high)) < 1e300
    return F.when(part == 0, low).when(near, fma(low, 1 - part, high * part)).otherwise(low + (high - low) * part)


def exact_quantiles(df: DataFrame, values: dict[str, Column], wanted: dict[str, tuple[str, float]], keys: Sequence[str] = (), most_left: int = MOST_LEFT) -> DataFrame:
    """One row (with keys: one for each combination) of exact quantiles, interpolated between the two nearest values.

    values: named columns; wanted: for each result the name of a value and its quantile. Null values don't count; a
    quantile of none is null. A null key is a key. Combinations of keys have to be few (splits, models), as the driver
    keeps bounds for each; without them an empty table gives a row of nulls.

    The values are written once as Parquet, a column each. Each pass is one aggregate over that table: it counts what
    lies below and between the bounds of every quantile and takes closer bounds from an approximate grid, which leaves
    about 1/30 of the values; once no more than most_left are left, those alone are taken out and ordered. A pass reads
    only the columns of open quantiles and shuffles a few numbers from each task; no row is multiplied.
    """
    names = list(values)
    safe = [f"_k{i}" for i in range(len(keys))]
    spark = df.sparkSession
    table = written(df.select(*[F.col(k).alias(s) for k, s in zip(keys, safe)], *[c.cast("double").alias(f"_v{i}") for i, c in enumerate(values.values())]), "quantiles")
    try:
        steps = [i / STEPS for i in range(STEPS + 1)]
        first = [a for i in range(len(names)) for a in (F.count(f"_v{i}"), F.min(f"_v{i}"), F.max(f"_v{i}"), F.percentile_approx(f"_v{i}", steps, ACCURACY))]
        found = table.groupBy(*safe).agg(*[a.alias(f"_a{i}") for i, a in enumerate(first)]).collect()  # a row for each combination
        groups = {tuple(r[s] for s in safe): g for g, r in enumerate(found)} or ({} if keys else {(): 0})
        sought, grids = [], {}
        for r in found:
            group = groups[tuple(r[s] for s in safe)]
            for name, (value, q) in wanted.items():
                c = names.index(value)
                n, low, high, grid = (r[f"_a{4 * c + j}"] for j in range(4))
                if n:
                    sought.append(_Sought(group, c, name, q * (n - 1), low, high, 0, n))
                    grids[group, name] = grid
        key_types = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields[: len(safe)]]

        def beside(bounds: dict[tuple[int, str], tuple[float, float]], asked: list[str]) -> DataFrame:
            """The table beside the bounds of its group: columns _l and _h for each quantile asked for (a row for each group)."""
            ends = [t for j in range(len(asked)) for t in (f"_l{j} double", f"_h{j} double")]
            rows = [(*k, g, *[e for n in asked for e in bounds.get((g, n), (None, None))]) for k, g in groups.items()]
            limits = spark.createDataFrame(rows, ", ".join([*key_types, "_g int", *ends])).withColumnsRenamed({s: f"{s}_" for s in safe})
            if not safe:
                return table.crossJoin(F.broadcast(limits))  # one row
            return table.join(F.broadcast(limits), [F.col(s).eqNullSafe(F.col(f"{s}_")) for s in safe])

        column = {n: F.col(f"_v{names.index(v)}") for n, (v, _) in wanted.items()}
        while open_ := [x for x in sought if x.within > most_left and x.low < x.high and (x.group, x.name) in grids]:
            closer = {(x.group, x.name): x.narrower(grids.pop((x.group, x.name))) for x in open_}
            asked = list(dict.fromkeys(x.name for x in open_))
            counts = []
            for j, n in enumerate(asked):
                v, low, high = column[n], F.col(f"_l{j}"), F.col(f"_h{j}")
                counts += [F.count_if(v < low).alias(f"_b{j}"), F.count_if(v.between(low, high)).alias(f"_w{j}"), F.percentile_approx(F.when(v.between(low, high), v), steps, ACCURACY).alias(f"_q{j}")]
            rows = {r["_g"]: r for r in beside(closer, asked).groupBy("_g").agg(*counts).collect()}  # a row for each group
            for x in open_:
                r, j = rows[x.group], asked.index(x.name)
                if x.holds(r[f"_b{j}"], r[f"_w{j}"]) and r[f"_w{j}"] < x.within:
                    (x.low, x.high), x.below, x.within = closer[x.group, x.name], r[f"_b{j}"], r[f"_w{j}"]
                    grids[x.group, x.name] = r[f"_q{j}"]

        # values of what is left, counted from the lower bound; a pair of bounds that are equal has one value
        asked = list(dict.fromkeys(x.name for x in sought))
        done: dict[int, dict[str, float]] = {}
        if asked:
            limits = beside({(x.group, x.name): (x.low, x.high) for x in sought}, asked)
            picked = F.array_compact(F.array(*[F.when(column[n].between(F.col(f"_l{j}"), F.col(f"_h{j}")), F.struct(F.lit(n).alias("_name"), column[n].alias("_v"))) for j, n in enumerate(asked)]))
            counts = limits.select("_g", F.explode(picked).alias("_x")).groupBy("_g", "_x._name", "_x._v").agg(F.count(F.lit(1)).alias("_n"))
            places = F.broadcast(spark.createDataFrame([(x.group, x.name, floor(x.at) - x.below, ceil(x.at) - x.below, x.at - floor(x.at)) for x in sought], "_g int, _name string, _first long, _second long, _part double"))
            upto = F.sum("_n").over(Window.partitionBy("_g", "_name").orderBy("_v"))
            placed = counts.withColumn("_upto", upto).join(places, ["_g", "_name"])
            low, high = (F.min(F.when(F.col("_upto") > F.col(c), F.col("_v"))) for c in ("_first", "_second"))
            ends = placed.groupBy("_g", "_name").agg(low.alias("_low"), high.alias("_high"), F.first("_part").alias("_part"))
            each = ends.select("_g", "_name", between(F.col("_low"), F.col("_high"), F.col("_part")).alias("_q"))
            for r in each.collect():  # a row for each quantile and group
                done.setdefault(r["_g"], {})[r["_name"]] = r["_q"]
    finally:
        drop_written(table)
    rows = [(*k, *[done.get(g, {}).get(n) for n in wanted]) for k, g in groups.items()]
    types = [*key_types, *[f"_q{i} double" for i in range(len(wanted))]]
    return spark.createDataFrame(rows, ", ".join(types)).select(*[F.col(s).alias(k) for k, s in zip(keys, safe)], *[F.col(f"_q{i}").alias(n) for i, n in enumerate(wanted)])


def with_quantiles(rows: DataFrame, quantiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A small table of aggregates beside the quantiles of the same keys (null keys included)."""
    if not keys:
        return rows.crossJoin(F.broadcast(quantiles))  # one row each
    names = [free_name([*rows.columns, *quantiles.columns], f"_j{i}") for i in range(len(keys))]
    right = quantiles.withColumnsRenamed(dict(zip(keys, names)))
    return rows.join(F.broadcast(right), [rows[k].eqNullSafe(right[n]) for k, n in zip(keys, names)], "left").drop(*names)
