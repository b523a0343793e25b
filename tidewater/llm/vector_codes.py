"""Vector codes by product quantisation with Yinyang Lloyd (operator 11).

Components become integers, vectors are cut into equal parts, and every part position has a codebook of its own. The
entries of a codebook are clustered into groups. A row keeps, for each part and group, a lower bound of the distance
to the group's entries other than its own. When entries move, a bound falls by the farthest move within its group;
only groups whose bound then isn't above the distance to the row's own entry are scanned. Distances, bounds and moves
are integers throughout (bounds rounded down, moves up), so a skipped group can neither win nor tie.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tidewater.llm.common import discard, materialize, tune

SCALE = 256
#: Bounds are kept in two bytes; a larger distance counts as this one, which bounds it all the same.
TOP = 65535
#: Components beyond this, scaled, raise an error, as sums of squares might not fit 64 bits.
LARGEST = 1 << 26


def usable(vector: Column) -> Column:
    """Vectors without null, NaN or infinite components; null vectors aren't."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of every component, with zeros behind vectors that are shorter than width."""
    lengths = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    return out


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows and entries, exact."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * max(1, x.shape[1]) < 1 << 52:  # doubles hold all of it
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for k, e in enumerate(entries):
        out[:, k] = ((x - e) ** 2).sum(1)
    return out


def root_down(squares: np.ndarray) -> np.ndarray:
    """Whole square roots, rounded down, and at most TOP."""
    squares = np.minimum(squares, TOP * TOP)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return root - (root * root > squares)


def group_entries(entries: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each entry: a few Lloyd rounds from entries that stand evenly apart in the codebook."""
    groups = max(1, min(groups, len(entries)))
    centres = entries[np.arange(groups) * len(entries) // groups].astype(np.float64)
    for _ in range(rounds):
        label = ((entries[:, None, :] - centres) ** 2).sum(2).argmin(1)
        for g in range(groups):
            if (label == g).any():
                centres[g] = entries[label == g].mean(0)
    return label


@dataclass
class Codebooks:
    """entries: by part, entry and component; groups: by part and entry; moved: by part and group, the farthest last move, rounded up."""

    entries: np.ndarray
    groups: np.ndarray
    moved: np.ndarray

    @classmethod
    def start(cls, entries: np.ndarray, groups: int) -> Codebooks:
        labels = np.stack([group_entries(e, groups) for e in entries]) if entries.shape[1] else np.zeros(entries.shape[:2], int)
        return cls(entries, labels, np.zeros((len(entries), groups), np.int64))

    def move(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebooks:
        """Entries that have parts become the floor of their means."""
        entries, moved = self.entries.copy(), np.zeros_like(self.moved)
        for (part, k), (count, total) in sums.items():
            entries[part, k] = [t // count for t in total]
        squares = ((entries - self.entries) ** 2).sum(2)
        for part in range(len(entries)):
            for k, square in enumerate(squares[part].tolist()):
                root = int(np.sqrt(square))
                while root * root < square:
                    root += 1
                g = self.groups[part, k]
                moved[part, g] = max(moved[part, g], root)
        return Codebooks(entries, self.groups, moved)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries, bounds and squared distances by part, by comparing with all entries. Of ties the lowest index wins."""
    n, parts, groups = len(x), len(books.entries), books.moved.shape[1]
    code, bounds, error = np.zeros((n, parts), np.int64), np.full((n, parts, groups), TOP, np.int64), np.zeros((n, parts), np.int64)
    for p, entries in enumerate(books.entries):
        d = distances(x[:, p], entries)
        code[:, p] = d.argmin(1)
        rows = np.arange(n)
        error[:, p] = d[rows, code[:, p]]
        d[rows, code[:, p]] = TOP * TOP
        for g in np.unique(books.groups[p]).tolist():
            bounds[:, p, g] = root_down(d[:, books.groups[p] == g].min(1))
    return code, bounds, error


def reassign(x: np.ndarray, code: np.ndarray, bounds: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As assign, from codes and bounds that held before the last move; also how many groups of rows were scanned."""
    code, bounds, error, scanned = code.copy(), np.maximum(bounds - books.moved, 0), np.zeros(code.shape, np.int64), 0
    for p, entries in enumerate(books.entries):
        own = code[:, p].copy()
        best, chosen = ((x[:, p] - entries[own]) ** 2).sum(1), own.copy()
        first = best.copy()
        fails = bounds[:, p] ** 2 <= best[:, None]
        looked = []
        for g in np.unique(books.groups[p]).tolist():
            rows = np.flatnonzero(fails[:, g])
            if not len(rows):
                continue
            scanned += len(rows)
            members = np.flatnonzero(books.groups[p] == g)
            d = distances(x[rows, p], entries[members])
            near = d.argmin(1)
            value, index = d[np.arange(len(rows)), near], members[near]
            wins = (value < best[rows]) | ((value == best[rows]) & (index < chosen[rows]))
            best[rows[wins]], chosen[rows[wins]] = value[wins], index[wins]
            looked.append((g, rows, members, d))
        left = np.flatnonzero(chosen != own)  # an entry that was left is one of the others of its group from now on
        home = books.groups[p][own[left]]
        bounds[left, p, home] = np.minimum(bounds[left, p, home], root_down(first[left]))
        for g, rows, members, d in looked:
            d[members[None, :] == chosen[rows][:, None]] = TOP * TOP
            bounds[rows, p, g] = root_down(d.min(1))
        code[:, p], error[:, p] = chosen, best
    return code, bounds, error, scanned


def _binary(rows: np.ndarray, kind: str) -> pa.Array:
    """One binary value for each row of an array."""
    flat = np.ascontiguousarray(rows.reshape(len(rows), -1).astype(kind))
    width = flat.shape[1] * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(flat)])


def _numbers(column: pa.Array, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape).astype(np.int64)


@dataclass
class Compressed:
    """rows: the kept columns, code (binary, an unsigned byte for each part) and error (long); books: the last codebooks."""

    rows: DataFrame
    books: Codebooks


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("label",), parts: int = 16, entries: int = 64, rounds: int = 2, groups: int = 8) -> Compressed:
    """Codes of all vectors after so many rounds of Lloyd.

    Vectors that are null or hold null, NaN or infinite components are left out. Codebooks start as the parts of the
    `entries` smallest keys (null keys last, equal keys by their vectors; with fewer rows there are fewer entries); a
    round assigns every part to its nearest entry, of ties the lowest, and moves entries to the floor of their means;
    at last all parts are assigned again. Vectors shorter than the longest, or than the next multiple of `parts`,
    count as filled with zeros. Equal rows are rows of their own and an empty table gives no rows. Columns of rows are
    key and those of keep; others are ignored. Scaled components beyond 2^26 raise an error.

    Rows, codes and bounds are written once a round and read by key of nothing: no row is shuffled. Tasks send
    sums of each entry, and the driver gets one row for each entry.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part")
    spark = vectors.sparkSession
    tune(spark)
    named = {f"k{i}": c for i, c in enumerate((key, *keep))}
    whole = vectors.select(*[F.col(c).alias(n) for n, c in named.items()], F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    seen = whole.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c))))).first()
    if (seen[1] or 0) * SCALE > LARGEST:
        raise ValueError("components are too large")
    width = -(-(seen[0] or 0) // parts) * parts
    size = width // parts
    firsts = whole.orderBy(F.col("k0").asc_nulls_last(), "v").limit(entries).select("v").toArrow().column("v").combine_chunks()  # at most `entries` rows
    shape = (parts, size)
    books = Codebooks.start(integers(firsts, width).reshape(len(firsts), *shape).transpose(1, 0, 2), groups)
    kinds = whole.drop("v").schema
    state_schema = StructType([*kinds, *StructType.fromDDL("x binary, code binary, bounds binary")])
    done_schema = StructType([*kinds, *StructType.fromDDL("code binary, error long")])

    def step(books: Codebooks, fresh: bool, last: bool):
        """A function over batches of vectors (fresh) or of written rows, which gives rows to write or (last) results."""

        def run(source):
            for batch in source:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    same = [part.column(n) for n in named]
                    if fresh:
                        x = integers(part.column("v"), width).reshape(part.num_rows, *shape)
                        code, bounds, error = assign(x, books)
                    else:
                        x, code = _numbers(part.column("x"), "<i4", shape), _numbers(part.column("code"), "u1", (parts,))
                        code, bounds, error, _ = reassign(x, code, _numbers(part.column("bounds"), "<u2", (parts, groups)), books)
                    if last:
                        yield pa.RecordBatch.from_arrays([*same, _binary(code, "u1"), pa.array(error.sum(1))], done_schema.fieldNames())
                    else:
                        yield pa.RecordBatch.from_arrays([*same, _binary(x, "<i4"), _binary(code, "u1"), _binary(bounds, "<u2")], state_schema.fieldNames())

        return run

    def totals(source):
        """Counts and sums of the parts of each entry, of all rows of a task."""
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in source:
            x, code = _numbers(batch.column("x"), "<i4", shape), _numbers(batch.column("code"), "u1", (parts,))
            for p in range(parts):
                count[p] += np.bincount(code[:, p], minlength=entries)
                np.add.at(sums[p], code[:, p], x[:, p])
        p, k = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(count[p, k]), pa.array(list(sums[p, k]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    state = None
    for _ in range(rounds):
        made = materialize((whole if state is None else state).mapInArrow(step(books, state is None, False), state_schema), "vector_state")
        if state is not None:
            discard(state)
        state = made
        sent = state.select("x", "code").mapInArrow(totals, "part long, entry long, n long, sums array<long>")
        gathered = sent.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.get("sums", F.lit(i))) for i in range(size)]).collect()  # a row for each entry
        books = books.move({(r[0], r[1]): (r[2], list(r[3:])) for r in gathered})
    rows = materialize((whole if state is None else state).mapInArrow(step(books, state is None, True), done_schema), "vector_codes")
    if state is not None:
        discard(state)
    return Compressed(rows.select(*[F.col(n).alias(c) for n, c in named.items()], "code", "error"), books)


#: Sums by label of at most so many labels are broadcast; beyond that rows and sums are joined by a shuffle.
FEW_LABELS = 100_000


def with_label_error(rows: DataFrame, label: str = "label") -> DataFrame:
    """rows with label_error: the sum of error over all rows of the same label; null is a label."""
    sums = rows.groupBy(F.col(label).alias("_label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col(label).eqNullSafe(F.col("_label")), "left").drop("_label")
