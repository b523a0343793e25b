"""Periodic runs of words by a harmonic grid (operator 13).

A run of period p and length of at least 3p contains neighbouring points jp and (j+1)p of the grid of p. How far the
words from there on agree, and how far those before do, are longest common extensions (LCE); they give the run's
ends. Points of all periods number n/1 + n/2 + ..., so a text of n words needs about n ln n extensions. They come from
the suffix array of the words, that of the reversed words, and minima over ranges of common prefix lengths.

Texts of a batch are handled together in NumPy: words are numbered within their text, so no extension leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewater.llm.common import release, tune

LEAST, REPEATS = 24, 3
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
BLOCK = 32


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by doubling: suffixes are ranked by 1, 2, 4, ... leading symbols.

    Only suffixes that share their rank with another are ranked again.
    """
    n = len(s)
    order = np.argsort(s, kind="stable")
    first = np.empty(n, bool)  # first of its rank, by place in order
    first[:1] = True
    first[1:] = s[order[1:]] != s[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = 1
    while True:
        shared = ~first
        shared[:-1] |= ~first[1:]
        at = np.flatnonzero(shared)
        if not len(at):
            return order
        own = order[at]
        follow = np.where(own + size < n, rank[np.minimum(own + size, n - 1)] + 1, 0)
        here = np.lexsort((follow, rank[own]))
        own, follow = own[here], follow[here]
        order[at] = own
        old = rank[own]
        first[at[1:]] = first[at[1:]] | (follow[1:] != follow[:-1]) | (old[1:] != old[:-1])
        rank[own] = np.maximum.accumulate(np.where(first[at], at, 0))
        size *= 2


def agreement(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols from a and from b on agree, compared symbol by symbol in pieces that grow."""
    n, out = len(s), np.zeros(len(a), np.int64)
    going, step = np.arange(len(a)), 4
    while len(going):
        reach = np.arange(step)
        x, y = (a[going] + out[going])[:, None] + reach, (b[going] + out[going])[:, None] + reach
        same = (x < n) & (y < n) & (s[np.minimum(x, n - 1)] == s[np.minimum(y, n - 1)])
        ended = ~same.all(1)
        out[going] += np.where(ended, same.argmin(1), step)
        going = going[~ended]
        step = min(max(4, (1 << 16) // max(len(going), 1)), 2 * step)
    return out


def common_prefixes(s: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each place in order but the first, the length that its suffix shares with the one before.

    Only where the symbols before both suffixes differ is it compared; those lengths add up to n log n at most. From
    there on each following suffix of the text shares one symbol less.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    open_ = (i == 0) | (before <= 0)
    open_[1:] |= s[i[1:] - 1] != s[before[1:] - 1]
    heads = np.flatnonzero(open_ & (before >= 0))
    found = np.zeros(n, np.int64)
    found[heads] = agreement(s, heads, before[heads])
    last = np.maximum.accumulate(np.where(open_, i, 0))
    by_text = np.where(before >= 0, found[last] - (i - last), 0)
    return by_text[order]


class RangeMinimum:
    """Minima of ranges in memory in proportion to the values: tables of powers of two over blocks, prefixes and suffixes within."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        blocks = -(-n // BLOCK)
        grid = np.full((blocks, BLOCK), np.iinfo(np.int64).max)
        grid.ravel()[:n] = values
        self.values = grid.ravel()
        self.prefix = np.minimum.accumulate(grid, 1).ravel()
        self.suffix = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
        self.levels = [grid.min(1)]
        while 2 << (len(self.levels) - 1) <= blocks:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(self.levels[-1][:-half], self.levels[-1][half:]))

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of values[a..b], both ends included and a <= b."""
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.suffix[a], self.prefix[b])
        same = np.flatnonzero(x == y)
        if len(same):
            reach = a[same][:, None] + np.arange(BLOCK)
            there = reach <= b[same][:, None]
            out[same] = np.where(there, self.values[np.minimum(reach, len(self.values) - 1)], np.iinfo(np.int64).max).min(1)
        wide = np.flatnonzero(y - x > 1)
        if len(wide):
            count = y[wide] - x[wide] - 1
            level = np.frexp(count.astype(float))[1] - 1
            for k in np.unique(level).tolist():
                of = wide[level == k]
                table = self.levels[k]
                out[of] = np.minimum(out[of], np.minimum(table[x[of] + 1], table[y[of] - (1 << k)]))
        return out


class Extensions:
    """Longest common extensions of two different places of a sequence."""

    def __init__(self, s: np.ndarray):
        order = suffix_array(s)
        self.place = np.empty(len(s), np.int64)
        self.place[order] = np.arange(len(s))
        self.minima = RangeMinimum(common_prefixes(s, order))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.place[a], self.place[b]
        out = np.zeros(len(a), np.int64)
        for at in range(0, len(a), 1 << 15):
            p = slice(at, at + (1 << 15))
            out[p] = self.minima.query(np.minimum(x[p], y[p]) + 1, np.maximum(x[p], y[p]))
        return out


def grid(starts: np.ndarray, sizes: np.ndarray, most: int = 1 << 18):
    """Blocks (texts, periods, points) of the grids of all texts: points jp of which (j+1)p lies within the text as well."""
    p, longest = 1, int(sizes.max(initial=0)) // REPEATS
    while p <= longest:
        texts = np.flatnonzero(sizes >= max(LEAST, REPEATS * p))
        periods = np.arange(p, min(2 * p, longest + 1))
        row, column = np.nonzero(sizes[texts][:, None] >= np.maximum(LEAST, REPEATS * periods))
        texts, periods = texts[row], periods[column]
        counts = (sizes[texts] - 1) // periods
        ends = np.cumsum(counts)
        for at in range(0, int(ends[-1]) if len(ends) else 0, most):
            k = np.arange(at, min(at + most, int(ends[-1])))
            of = np.searchsorted(ends, k, side="right")
            yield texts[of], periods[of], starts[texts[of]] + (k - (ends[of] - counts[of])) * periods[of]
        p *= 2


def candidates(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """Blocks (texts, periods, points) of the points of the grids at which a run may be.

    The first point jp of a run of period p is less than p behind its start, so the words at jp + t and (j+1)p + t
    agree for every t up to the larger of p and 24 - 2p. Five such t are looked at, which leaves few points of
    ordinary texts; extensions decide about the rest.
    """
    for texts, periods, points in grid(starts, sizes):
        for part in (0, 4, 2, 1, 3):
            t = np.maximum(periods, LEAST - 2 * periods) * part // 4
            x = points + periods + t
            ok = x < starts[texts] + sizes[texts]
            ok[ok] = s[(points + t)[ok]] == s[x[ok]]
            texts, periods, points = texts[ok], periods[ok], points[ok]
        if len(texts):
            yield texts, periods, points


def find_runs(s: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All runs as rows (text, start, length, period), ascending; texts are s[start:start + size], one behind the other.

    Symbols are numbers; equal ones in different texts count as different.
    """
    hit = np.zeros(len(sizes), bool)
    for texts, _, _ in candidates(s, starts, sizes):
        hit[texts] = True
    used = np.flatnonzero(hit)
    if not len(used):
        return np.zeros((0, 4), np.int64)
    # texts without a candidate can't have a run; the others are put together, each with symbols of its own
    offset = np.concatenate([[0], np.cumsum(sizes[used])])
    whole = np.concatenate([s[starts[i] : starts[i] + sizes[i]] for i in used.tolist()])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    symbols = np.unique(owner * (int(s.max()) + 1) + whole, return_inverse=True)[1].astype(np.int64)
    n, found = len(symbols), []
    forward, backward = Extensions(symbols), Extensions(symbols[::-1].copy())
    for texts, periods, points in candidates(symbols, offset[:-1], sizes[used]):
        ahead = forward(points, points + periods)
        back = np.zeros(len(points), np.int64)
        inner = np.flatnonzero(points > offset[texts])
        back[inner] = backward(n - points[inner], n - points[inner] - periods[inner])
        length = ahead + back + periods
        long = length >= np.maximum(LEAST, REPEATS * periods)
        rows = np.stack([used[texts[long]], (points - back - offset[texts])[long], length[long], periods[long]], 1)
        found.append(np.unique(rows, axis=0))
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    rows = rows[np.lexsort(rows.T[[3, 2, 1, 0]])]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)  # of equal stretches the smallest period
    rows = rows[first]
    return rows[np.lexsort(rows.T[[3, 1, 0]])]


Reorder = Callable[[object, int], "np.ndarray | None"]


def runs_of(docs: DataFrame, reorder: Reorder | None = None) -> DataFrame:
    """The runs of every whole text, and the text without their repeats.

    Words are `[^\\x20\\x09-\\x0D]+`. A run is a stretch that keeps its smallest period, that no neighbouring word
    extends, and that has at least 24 words and three periods. Returns doc_id, n_words, runs (array of start, length
    and period, ascending) and collapsed: the words that stay, joined by one space, without those behind the first
    period of any run. Null and empty texts have no words, no runs and an empty collapsed text. Repeated rows and ids
    have results each, a null doc_id stays null, extra columns are ignored and an empty table gives none.

    reorder(doc_id, n) may give places of the text's n words to take in their stead, or None.

    One pass without a shuffle; lost tasks run again. A text of n words needs memory in proportion to n, and time to
    n log^2 n.
    """
    tune(docs.sparkSession)
    names = [c.split()[0] for c in ("doc_id long", "n_words long", "runs array", "collapsed string")]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def handle(keys: list, texts: list[str | None]) -> pa.RecordBatch:
        words: list[list[bytes]] = []
        for key, t in zip(keys, texts):
            w = t.encode().split() if t else []
            places = reorder(key, len(w)) if reorder and w else None
            words.append(w if places is None else [w[i] for i in places.tolist()])
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        every = [w for ws in words for w in ws]
        numbers: dict[bytes, int] = {}
        s = np.fromiter((numbers.setdefault(w, len(numbers)) for w in every), np.int64, len(every))
        rows = find_runs(s, starts, sizes)
        cut = np.searchsorted(rows[:, 0], np.arange(len(words) + 1))
        change = np.zeros(len(s) + 1, np.int64)
        base = starts[rows[:, 0]] if len(rows) else np.zeros(0, np.int64)
        np.add.at(change, base + rows[:, 1] + rows[:, 3], 1)
        np.add.at(change, base + rows[:, 1] + rows[:, 2], -1)
        dropped = np.cumsum(change[:-1]) > 0
        collapsed = []
        for i, w in enumerate(words):
            own = dropped[starts[i] : starts[i] + sizes[i]]
            collapsed.append(b" ".join(w if not own.any() else [w[k] for k in np.flatnonzero(~own).tolist()]).decode())
        parts = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in (1, 2, 3)], fields=list(kind.value_type))
        runs = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), parts).cast(kind)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes), runs, pa.array(collapsed, pa.string())], names)

    def run(source):
        for batch in source:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            a, total = 0, 0
            for i, n in enumerate(lengths.tolist()):
                if i > a and total + n > 1 << 20:
                    yield handle(keys[a:i], texts.slice(a, i - a).to_pylist())
                    a, total = i, 0
                total += n
            if a < len(keys):
                yield handle(keys[a:], texts.slice(a).to_pylist())
        release()

    return docs.select("doc_id", "text").mapInArrow(run, RUNS)
