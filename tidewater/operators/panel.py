"""Ordered-window operators of a panel: rows grouped by an entity and ordered in time.

Every operator gives columns, not frames, so that one select computes a whole layer behind one exchange. Frames of
past values end before the current row, which joins the shift and the window into one frame.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window, WindowSpec

from tidewater.functions.nulls import EPSILON, flag, zero

FIRST, LAST, NOW = Window.unboundedPreceding, Window.unboundedFollowing, Window.currentRow


@dataclass(frozen=True)
class Panel:
    """entity: the group; order: columns that order its rows; slot: the name of the row number from 0.

    Frames count rows, so all rows of an entity are ordered in one task: entities have to be short (a scenario has some
    dozens of rows), however many there are. For long histories there are frames over spans of time in `timeframes`.
    """

    entity: str
    order: tuple[str, ...]
    slot: str = "timeslot"

    # windows

    @property
    def rows(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(*self.order)

    @property
    def group(self) -> WindowSpec:
        return Window.partitionBy(self.entity)

    def past(self, n: int | None = None) -> WindowSpec:
        """The n rows before the current one, or all before it."""
        return self.rows.rowsBetween(FIRST if n is None else -n, -1)

    # position

    def with_slot(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.slot, F.row_number().over(self.rows) - 1)

    def lag(self, c: str | Column, k: int = 1) -> Column:
        return F.lag(c, k).over(self.rows)

    def diff(self, c: str | Column, k: int = 1) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return c - self.lag(c, k)

    # past windows

    def roll(self, c: str | Column, n: int, how: str) -> Column:
        """mean, max, min, std or sum of the n rows before; null without values (std: fewer than two)."""
        return {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "sum": F.sum}[how](c).over(self.past(n))

    def cumulative_sum(self, c: str | Column) -> Column:
        return F.coalesce(F.sum(c).over(self.past()), F.lit(0.0))

    def expanding(self, c: str | Column, how: str) -> Column:
        return {"mean": F.avg, "max": F.max}[how](c).over(self.past())

    def ewm(self, c: str | Column, decay: float) -> Column:
        """y = decay y + (1 - decay) x over the past, from 0, missing values as 0.

        Rows so far back that their weight is below 2^-60 are left out, which no double can show; so a row folds at
        most log(2^-60) / log(decay) values (811 at 0.95), however long the entity is.
        """
        c = F.col(c) if isinstance(c, str) else c
        seen = 1 if decay <= 0 else ceil(-60 * log(2) / log(decay)) if decay < 1 else None
        past = F.collect_list(zero(c.cast("double"))).over(self.past(seen))
        return F.aggregate(past, F.lit(0.0), lambda a, x: decay * a + (1 - decay) * x)

    def slope(self, c: str, n: int = 5) -> Column:
        """Least-squares slope over the n rows before; null unless all n are there and not null."""
        return F.when(F.count(c).over(self.past(n)) == n, F.regr_slope(F.col(c), F.col(self.slot)).over(self.past(n)))

    def past_state(self, condition: Column) -> Column:
        return F.coalesce(self.lag(flag(condition)), F.lit(0))

    def state_count(self, condition: Column, n: int) -> Column:
        """How many of the n rows before hold the condition."""
        return F.coalesce(F.sum(flag(condition)).over(self.past(n)), F.lit(0))

    def add_runs(self, df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
        """For each name, how many rows in a row before the current one hold the condition."""
        states = df.select("*", *[self.past_state(c).alias(f"_s_{n}") for n, c in conditions.items()])
        breaks = states.select("*", *[F.sum(1 - F.col(f"_s_{n}")).over(self.rows.rowsBetween(FIRST, NOW)).alias(f"_b_{n}") for n in conditions])
        for n in conditions:
            island = Window.partitionBy(self.entity, f"_b_{n}").orderBy(*self.order).rowsBetween(FIRST, NOW)
            breaks = breaks.withColumn(n, F.sum(f"_s_{n}").over(island))
        return breaks.drop(*[f"_{k}_{n}" for k in "sb" for n in conditions])

    def add_crossings(self, df: DataFrame, wanted: dict[str, tuple[Column, dict[str, int]]]) -> DataFrame:
        """For each condition and each of its names, how often within the last n rows the shifted state went from 0 to 1.

        wanted: for each state its condition and result names with their n; all states share two layers.
        """
        states = df.select("*", *[self.past_state(c).alias(f"_s_{k}") for k, (c, _) in wanted.items()])
        rose = lambda k: ((F.col(f"_s_{k}") == 1) & (F.coalesce(self.lag(f"_s_{k}"), F.lit(0)) == 0)).cast("int")
        crossed = states.select("*", *[rose(k).alias(f"_c_{k}") for k in wanted])
        sums = [F.sum(f"_c_{k}").over(self.rows.rowsBetween(-n + 1, NOW)).alias(name) for k, (_, names) in wanted.items() for name, n in names.items()]
        return crossed.select("*", *sums).drop(*[f"_{x}_{k}" for x in "sc" for k in wanted])

    def first_n(self, c: str, how: str, n: int = 4) -> Column:
        """mean or max over the first n rows of the entity from row n on, 0 before."""
        early = F.when(F.col(self.slot) < n, F.col(c))
        value = {"mean": F.avg, "max": F.max}[how](early).over(self.group)
        return F.when(F.col(self.slot) >= n, value).otherwise(F.lit(0.0))

    def cumulative_family(self, c: str | Column) -> dict[str, Column]:
        """Sum and mean of the past (missing as 0, so that the mean divides by all rows so far), the step, and its products."""
        c = F.col(c) if isinstance(c, str) else c
        total = self.cumulative_sum(c)
        mean = total / (F.col(self.slot) + 1)
        step = zero(self.diff(c))
        return {"cumsum_prev": total, "cummean_prev": mean, "diff1": step, "diff_x_cumsum": step * total, "diff_x_cummean": step * mean}

    def context(self, c: str | Column, n: int) -> dict[str, Column]:
        """mean, max, std of the n rows before and the distance from that mean, all with missing as 0."""
        c = F.col(c) if isinstance(c, str) else c
        mean = self.roll(c, n, "mean")
        return {"mean": zero(mean), "max": zero(self.roll(c, n, "max")), "std": zero(self.roll(c, n, "std")), "vs_mean": zero(c - mean)}

    # whole entities

    def rank_pct(self, c: str) -> Column:
        """Average rank among the entity's values, divided by their number; null stays null."""
        order = self.group.orderBy(F.col(c).asc_nulls_last())
        ties = F.count(c).over(order.rangeBetween(NOW, NOW))  # of the same sort as the rank
        return F.when(F.col(c).isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(c).over(self.group))

    def relative(self, c: str) -> dict[str, Column]:
        """Distance from the entity's mean, z-score (missing as 0), share of the maximum, place in the range."""
        x, g = F.col(c), self.group
        mean, std, high, low = F.avg(c).over(g), F.nullif(F.stddev_samp(c).over(g), F.lit(0.0)), F.max(c).over(g), F.min(c).over(g)
        return {
            "relmean": x - mean,
            "z": zero((x - mean) / (std + EPSILON)),
            "to_max": x / (F.abs(high) + EPSILON),
            "range_pos": (x - low) / (F.abs(high - low) + EPSILON),
        }

    def quantile(self, c: str, q: float) -> Column:
        return F.percentile(c, F.lit(q)).over(self.group)

    # filling

    def forward_back(self, c: str) -> Column:
        return F.coalesce(F.last(c, True).over(self.rows.rowsBetween(FIRST, NOW)), F.first(c, True).over(self.rows.rowsBetween(NOW, LAST)))

    def linear(self, c: str, causal: bool = False) -> Column:
        """Interpolated by position between neighbours, with the nearest value at the ends; causal: the last value only."""
        before, after = self.rows.rowsBetween(FIRST, NOW), self.rows.rowsBetween(NOW, LAST)
        v0 = F.last(c, True).over(before)
        if causal:
            return v0
        at = F.when(F.col(c).isNotNull(), F.col(self.slot))
        v1, s0, s1 = F.first(c, True).over(after), F.last(at, True).over(before), F.first(at, True).over(after)
        between = v0 + (v1 - v0) * (F.col(self.slot) - s0) / F.nullif(s1 - s0, F.lit(0))
        return F.coalesce(F.col(c), between, v0, v1)
