"""Fill strategies for feature columns; each ends with the sentinel for what is still missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidewater.functions.nulls import SENTINEL
from tidewater.operators.panel import Panel
from tidewater.registry import lineage

STRATEGIES = ("minus999", "ffill_bfill", "linear", "roll_std_zero")


def fill(df: DataFrame, columns: Sequence[str], strategy: str, panel: Panel, causal: bool = False) -> DataFrame:
    """df with `columns` filled. linear and ffill_bfill work within an entity and on ordered-window columns only.

    Which columns are lags, differences or rolls, and which of those deviations, is read from their metadata; columns
    that carry none go by their names. Filled columns keep their metadata. linear fills leading gaps from later rows unless causal; an entity without any value gets the sentinel.
    roll_std_zero sets missing rolling deviations to 0.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    known = lineage(df)
    ordered = {c for c in columns if (known[c].kind in ("lag", "diff", "roll") if c in known else any(m in c for m in ("_lag", "_diff", "_roll")))}
    deviations = {c for c in columns if ((known[c].kind, known[c].how) == ("roll", "std") if c in known else "_roll" in c and "_std" in c)}
    named = {}
    for c in columns:
        if strategy == "ffill_bfill" and c in ordered:
            value = panel.forward_back(c)
        elif strategy == "linear" and c in ordered:
            value = panel.linear(c, causal)
        elif strategy == "roll_std_zero" and c in deviations:
            value = F.coalesce(F.col(c), F.lit(0.0))
        else:
            value = F.col(c)
        named[c] = F.coalesce(value, F.lit(SENTINEL))
    kept = lambda c: known[c].label(named[c]) if c in known else named[c].alias(c)
    return df.select(*[kept(c) if c in named else F.col(c) for c in df.columns])
