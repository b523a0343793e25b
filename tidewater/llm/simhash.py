"""SimHash fingerprints and near-duplicate components by bit-sliced comparison (operator 9).

Fingerprints within radius 2 differ in at most two of four 16-bit blocks, so they share two whole blocks: six tables,
one for each pair of blocks, bring every linked pair together. In a bucket the fingerprints stand as bit planes, 64
to a word; one fingerprint is held against 64 at a time, bit after bit, with carry-save counters that saturate
beyond the radius, and a word is left as soon as all its lanes exceed it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewater.llm.common import free_name, let_go, materialize, tune
from tidewater.llm.components import components
from tidewater.llm.similar import shingle_hashes, similar_links

RADIUS = 2
#: Buckets of more distinct fingerprints are split by further blocks, which bounds them by 2^16.
HOT = 4096
#: Pairs of a fingerprint and a word of lanes that are held at a time.
TASKS = 1 << 15

U = np.uint64


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, more: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and further longs by name of every whole text.

    A-Z are lower-cased; words end at spaces and the characters U+0009 to U+000D. Null texts and texts without words
    have fingerprint zero. Repeated rows have a row each; extra columns are ignored.
    """
    tune(docs.sparkSession)

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                fps = np.array([fingerprint(shingle_hashes(t, width)) for t in part.column("text").to_pylist()], U)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)), *(part.column(c) for c in names)], ["doc_id", "fp", *names])

    more = more or {}
    names = list(more)
    return docs.select("doc_id", "text", *[c.alias(n) for n, c in more.items()]).mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{n} long" for n in names]]))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all fingerprints (of one word or a row of words each), 64 to a word; lane i of word w is fingerprint 64 w + i."""
    words = fps.reshape(len(fps), -1)
    padded = np.zeros((-(-len(fps) // 64) * 64, words.shape[1]), "<u8")
    padded[: len(fps)] = words
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), -1), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8").astype(U)


def near_lanes(fps: np.ndarray, planes: np.ndarray, row: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of a row and a word, the lanes within the radius: the pairs that have any, and a mask of lanes for each."""
    depth = int(radius + 1).bit_length()
    counters = [np.zeros(len(row), U) for _ in range(depth)]
    over = np.zeros(len(row), U)
    words, full = fps.reshape(len(fps), -1), U(0xFFFFFFFFFFFFFFFF)
    for b in range(len(planes)):
        if b % 64 == 0:
            mine = words[row, b // 64]
        carry = planes[b][word] ^ (U(0) - (mine >> U(b % 64) & U(1)))
        for k in range(depth):
            carry, counters[k] = counters[k] & carry, counters[k] ^ carry
        over |= carry
        if b % 8 == 7 and len(row):
            keep = np.flatnonzero((over | _exceeds(counters, radius)) != full)
            if len(keep) < len(row):
                row, word, mine, over = row[keep], word[keep], mine[keep], over[keep]
                counters = [c[keep] for c in counters]
    return row, word, ~(over | _exceeds(counters, radius))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is over the radius."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def links_in_buckets(fps: np.ndarray, ends: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of each bucket: rows and the first row of their component in the bucket.

    ends: where each bucket ends in fps. All pairs of a bucket are compared; a spanning set of them is returned.
    """
    n = len(fps)
    label = np.arange(n)
    starts = np.concatenate([[0], ends[:-1]])
    first, last = np.repeat(starts, ends - starts), np.repeat(ends, ends - starts)
    rows = np.flatnonzero(np.arange(n) + 1 < last)  # each pair once: the lanes after the row
    planes = bit_planes(fps)
    lo, hi = (rows + 1) >> 6, (last[rows] - 1) >> 6
    counts = hi - lo + 1
    total = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(total, total[at] + TASKS, side="right")) - 1)
        c = counts[at:to]
        row = np.repeat(rows[at:to], c)
        word = np.repeat(lo[at:to], c) + np.arange(len(row)) - np.repeat(total[at:to] - total[at], c)
        row, word, lanes = near_lanes(fps, planes, row, word, radius)
        bits = np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, lane = np.nonzero(bits)
        a, b = row[k], word[k] * 64 + lane
        valid = (b > a) & (b < last[a])
        label = _merge(label, a[valid], b[valid])
        at = to
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest labels of joined components."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, shorter := label[label]):
            label = shorter


def _bucket_edges(source):
    """Edges of buckets that arrive sorted by key."""
    held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def edges(key, fp):
        if not len(key):
            return None
        cut = np.flatnonzero(np.diff(key)) + 1
        ends = np.concatenate([cut, [len(key)]])
        sizes = np.diff(np.concatenate([[0], ends]))
        keep = np.repeat(sizes > 1, sizes)
        fp, sizes = fp[keep], sizes[sizes > 1]
        if not len(fp):
            return None
        a, b = links_in_buckets(fp.view(U), np.cumsum(sizes))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"]) if len(a) else None

    for batch in source:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if (out := edges(key[:cut], fp[:cut])) is not None:
            yield out
        held_key, held_fp = key[cut:], fp[cut:]
    if (out := edges(held_key, held_fp)) is not None:
        yield out


def _field(fp, shift: int, bits: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))


def _keys(fields: list, share: int) -> list:
    """Hash keys of all ways to choose `share` of the fields."""
    return [F.xxhash64(F.lit(i), *chosen) for i, chosen in enumerate(combinations(fields, share))]


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints fp within the radius, at most one for each fingerprint and bucket.

    distinct: a written table. Two keys that collide in 64 bits share a bucket, which adds comparisons and no links.
    A bucket with over HOT fingerprints is dealt out anew by two of four 8-bit blocks of the remaining 32 bits: such
    a bucket fixes 48 bits, so it has at most 2^16 fingerprints, whatever the table's size.
    """
    blocks = [_field(F.col("fp"), 16 * i, 16) for i in range(4)]
    first = distinct.select("fp", F.posexplode(F.array(*_keys(blocks, 2))).alias("table", "key"))
    hot = first.groupBy("table", "key").count().filter(F.col("count") > HOT).select("table", "key", F.lit(True).alias("hot"))
    marked = first.join(hot, ["table", "key"], "left")
    again = None
    for t, pair in enumerate(combinations(range(4), 2)):
        rest = [i for i in range(4) if i not in pair]
        eighths = [_field(F.col("fp"), 16 * i + 8 * j, 8) for i in rest for j in range(2)]
        keys = F.array(*[F.xxhash64("table", "key", k) for k in _keys(eighths, 2)])
        again = F.when(F.col("table") == t, keys) if again is None else again.when(F.col("table") == t, keys)
    keyed = marked.select("fp", F.explode(F.when(F.col("hot"), again).otherwise(F.array("key"))).alias("key"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_edges, "a long, b long")


def named_components(own: DataFrame) -> DataFrame:
    """fp and root (one fingerprint for each component) of every distinct fingerprint of own, a written table."""
    distinct = materialize(own.select("fp").distinct(), "distinct")
    edges = materialize(linked_pairs(distinct), "links")
    return distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links lead to, itself included) of every row.

    Texts with equal fingerprints are one node, so copies add no comparisons. Null doc_ids belong to the component of
    their fingerprint and never name it (null if all are null). An empty table gives none.
    """
    own = materialize(fingerprints(docs, width), "fingerprints")
    smallest = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = named_components(own).join(smallest, "fp")
    names = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(names, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", "fp", "component_id")


def distinct_marks(hashed: DataFrame) -> Column:
    """A long for each text from columns h1 and h2, 64-bit hashes with different seeds; texts with equal ones are taken for equal.

    It is h1, but where texts with one h1 differ in h2 (some hundred pairs among 10^11 texts): those are told apart.
    hashed: a written table. Over 10,000 such values raise an error, as hashes of texts never give so many.
    """
    clashes = hashed.groupBy("h1").agg(F.min("h2").alias("low"), F.max("h2").alias("high")).filter("low < high").select("h1").limit(10_001)
    found = [r[0] for r in clashes.collect()]
    if len(found) > 10_000:
        raise ValueError("too many texts share a hash")
    return F.when(F.col("h1").isin(found), F.xxhash64("h1", "h2")).otherwise(F.col("h1")) if found else F.col("h1")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest doc_id (null last), of equal ones the first row.

    Texts are linked if their fingerprints over three words differ in at most two bits, or if the Jaccard similarity of
    their sets of five-word shingles is 0.8 or more; groups are what links connect. Null texts are alike, and linked with
    texts without words, whose fingerprint is zero too. Other columns stay as they are; repeated rows are copies like
    any others; an empty table stays empty. Rows are numbered in a written copy and kept by number, so texts are
    moved once, to meet the numbers that stay.
    """
    tune(docs.sparkSession)
    row = free_name(docs.columns, "_row")
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    own = materialize(fingerprints(numbered, more={"row": F.col(row), "h1": h1, "h2": h2}), "fingerprints")
    marks = distinct_marks(own)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    texts = materialize(own.groupBy(marks.alias("mark")).agg(F.min("fp").alias("fp"), first), "texts")
    reps = materialize(texts.groupBy("fp").agg(F.min("mark").alias("rep")), "distinct")
    same = texts.join(reps, "fp").select(F.col("mark").alias("a"), F.col("rep").alias("b"))
    near = linked_pairs(reps.select("fp"))
    for end in ("a", "b"):
        near = near.join(reps.select(F.col("fp").alias(end), F.col("rep").alias(f"r{end}")), end)
    edges = materialize(same.unionByName(near.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "links")
    let_go(docs.sparkSession)
    marked = numbered.select(h1.alias("h1"), h2.alias("h2"), "text").select(marks.alias("mark"), "text")
    roots = components(edges.unionByName(similar_links(marked, edges))).withColumnRenamed("node", "mark")
    groups = texts.select("mark", "first").join(roots, "mark", "left").groupBy(F.coalesce("root", "mark")).agg(F.min("first").alias("first"))
    stay = groups.select(F.col("first.row").alias(row))
    kept = numbered.join(stay, row, "left_semi").drop(row)
    return kept.select(*docs.columns)


def as_hex(fp):
    """16 lowercase hexadecimal digits of a column of 64 bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
