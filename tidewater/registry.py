"""What each feature column is: its kind, base column, window and statistic, so that sets are chosen by data, not by name.

The feature layers write this into the metadata of the columns they make. Spark carries a column's metadata through
selects, filters, joins and Parquet files, so a stored frame still knows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import NumericType

#: The entry of a column's metadata.
ENTRY = "feature"
#: Kinds that are added to a set only when asked for by name, in the mode `active`.
OPTIONAL = ("cumsum", "decay", "slope", "persistence")
#: Kinds that each mode starts from; None: all but the optional ones.
MODES: dict[str, tuple[str, ...] | None] = {"active": None, "roll_only": ("roll",), "roll_base": ("raw", "roll"), "roll_base_layout": ("raw", "layout", "roll")}


@dataclass(frozen=True)
class Feature:
    """window: of rolls the number of rows, of lags and differences the step; how: the statistic, where there is one."""

    name: str
    kind: str
    base: str | None = None
    window: int | None = None
    how: str | None = None

    def label(self, c: Column) -> Column:
        """c under this feature's name, with what it is in its metadata."""
        told = {"kind": self.kind, "base": self.base, "window": self.window, "how": self.how}
        return c.alias(self.name, metadata={ENTRY: {k: v for k, v in told.items() if v is not None}})


def lineage(df: DataFrame) -> dict[str, Feature]:
    """The features among df's columns that carry what they are, by name."""
    return {f.name: Feature(f.name, **f.metadata[ENTRY]) for f in df.schema if ENTRY in (f.metadata or {})}


def describe(name: str) -> Feature:
    """The feature that a column name of the usual form stands for."""
    if m := re.fullmatch(r"(.+)_(lag|diff)(\d+)", name):
        return Feature(name, m[2], m[1], int(m[3]))
    if m := re.fullmatch(r"(.+)_(?:count|cross)_roll(\d+)", name):
        return Feature(name, "persistence", m[1], int(m[2]))
    if m := re.fullmatch(r"(.+)_run_length", name):
        return Feature(name, "persistence", m[1])
    if m := re.fullmatch(r"(.+)_(?:cumsum_prev|cummean_prev)", name):
        return Feature(name, "cumsum", m[1])
    if m := re.fullmatch(r"(.+?)(_vs)?_ctxroll(\d+)(_\w+)?", name):
        return Feature(name, "context", m[1], int(m[3]))
    if m := re.fullmatch(r"(.+?)(_vs)?_roll(\d+)(_\w+)?", name):
        return Feature(name, "roll", m[1], int(m[3]))
    for kind, mark in (("cumsum", "_cumsum"), ("decay", "_decay"), ("slope", "_slope")):
        if mark in name:
            return Feature(name, kind, name.split(mark)[0])
    return Feature(name, "raw")


@dataclass
class Registry:
    features: dict[str, Feature] = field(default_factory=dict)

    def add(self, names: Iterable[str]) -> Registry:
        for n in names:
            self.features.setdefault(n, describe(n))
        return self

    @classmethod
    def of(cls, df: DataFrame, without: Iterable[str] = ()) -> Registry:
        """The numeric columns of df, but those of `without`, by their metadata; columns that carry none are raw. Names aren't read."""
        skipped, known = set(without), lineage(df)
        return cls({f.name: known.get(f.name, Feature(f.name, "raw")) for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in skipped})

    def kinds(self) -> set[str]:
        return {f.kind for f in self.features.values()}

    def windows(self) -> list[int]:
        """The windows of rolls, ascending."""
        return sorted({f.window for f in self.features.values() if f.kind == "roll" and f.window is not None})

    def select(
        self, windows: Iterable[int] | None = None, lags: Iterable[int] | None = None, without: Iterable[str] = (), bases: Iterable[str] | None = None,
        mode: str | None = None, groups: Iterable[str] = (),
    ) -> list[str]:
        """Names in order, each once: of rolls those with a window asked for, of lags and differences those with a step.

        without: kinds or names that are left out. mode: one of MODES, else all kinds; in the mode `active`, groups
        are the optional kinds to take as well.
        """
        if mode is not None and mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        windows, lags = set(windows) if windows is not None else None, set(lags) if lags is not None else None
        without, bases = set(without), set(bases) if bases is not None else None
        kinds = self.kinds() if mode is None else set(MODES[mode] or (self.kinds() - set(OPTIONAL)) | (self.kinds() & set(groups)))
        out = []
        for f in self.features.values():
            if f.kind not in kinds or f.kind in without or f.name in without or (bases is not None and f.base and f.base not in bases):
                continue
            if f.kind == "roll" and windows is not None and f.window not in windows:
                continue
            if f.kind in ("lag", "diff") and lags is not None and f.window not in lags:
                continue
            out.append(f.name)
        return list(dict.fromkeys(out))


def prune_by_importance(importance: dict[str, float], kept_kinds: tuple[str, ...] = ("roll", "cumsum", "decay", "persistence"), share: float = 0.05, least: int = 20, registry: Registry | None = None) -> list[str]:
    """Columns to drop: no gain, in the bottom max(least, share) of the ranking, and of no kept kind.

    registry: what the columns are; columns that it lacks go by their names.
    """
    known = registry.features if registry else {}
    kind = lambda n: (known.get(n) or describe(n)).kind
    ranked = sorted(importance, key=lambda n: (-importance[n], n))
    tail = set(ranked[-max(least, int(len(ranked) * share)) :])
    return [n for n in ranked if n in tail and importance[n] == 0 and kind(n) not in kept_kinds]
