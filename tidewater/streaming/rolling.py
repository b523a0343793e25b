"""Extension: past-window features over a stream of events, with state that ends.

State is the last `window` values, their running sum and the time of the last event of each user. A timer clears it
once the watermark is `idle` past that time, so users who left take no room; should they come back, they start anew.
Within a micro-batch rows are ordered by (ts, event_id); rows later than the watermark are dropped by Spark. Features
are those of Panel.roll, Panel.lag and cumulative sums, causal by nature.

The state needs the RocksDB store: set spark.sql.streaming.stateStore.providerClass to PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "user_id long, event_id long, ts timestamp, value double, lag1 double, roll_mean double, roll_max double, cumsum double"
STATE = "recent array<double>, total double, expires long"


class PastWindow(StatefulProcessor):
    """Rolling features of one user's events; window: values that are kept; idle: milliseconds of event time without events after which state ends."""

    def __init__(self, window: int, idle: int):
        self.window, self.idle = window, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("past", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent, total, expires = self.state.get() if self.state.exists() else ([], 0.0, None)
        df = pd.concat(list(rows)).sort_values(["ts", "event_id"], ignore_index=True)
        values = pd.concat([pd.Series(list(recent), dtype=float), df["value"].astype(float)], ignore_index=True)
        past = values.shift(1).rolling(self.window, min_periods=1)
        sums = total + np.concatenate([[0.0], df["value"].astype(float).fillna(0.0).cumsum().to_numpy()])
        own = slice(len(recent), None)
        yield pd.DataFrame({
            "user_id": key[0], "event_id": df["event_id"], "ts": df["ts"], "value": df["value"],
            "lag1": values.shift(1)[own].to_numpy(), "roll_mean": past.mean()[own].to_numpy(), "roll_max": past.max()[own].to_numpy(), "cumsum": sums[:-1],
        })
        last = int(df["ts"].max().timestamp() * 1000) + self.idle
        until = last if expires is None else max(expires, last)
        if until != expires:
            if expires is not None:
                self.handle.deleteTimer(expires)
            self.handle.registerTimer(until)
        self.state.update((values.tail(self.window).tolist(), float(sums[-1]), until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def rolling_features(stream: DataFrame, window: int, delay: str = "10 minutes", idle: str = "30 days") -> DataFrame:
    """stream: user_id, event_id, ts, value. One output row for each event; idle: event time after which a user's state ends."""
    named = stream.withWatermark("ts", delay)
    kept = int(pd.Timedelta(idle).total_seconds() * 1000)
    return named.groupBy("user_id").transformWithStateInPandas(PastWindow(window, kept), OUT, "Append", "EventTime")
