"""Document fingerprints by winnowing (operator 4).

Rolling hashes of all k-grams of code points; of each window of w consecutive hashes the smallest is a mark, the
rightmost where several are equal. Texts that share a passage of w + k - 1 code points share a mark, and no passage
shorter than k makes one. Positions are kept with the marks.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import tune

GRAM, SPAN = 12, 16
U = np.uint64
BASE = 0x9E3779B97F4A7C15
LOW = U(0xFFFFFFFF)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """32-bit hashes of all runs of k code points, each run's put together from those of runs of powers of two."""
    known, size, power, done, out = c.astype(U) + U(1), 1, BASE, 0, None
    while True:
        if k & size:  # `out` covers the first `done` places of a run
            out = known if out is None else out[: len(known) - done] * U(power) + known[done:]
            done += size
        if 2 * size > k:
            break
        known = known[:-size] * U(power) + known[size:]
        power, size = power * power & 0xFFFFFFFFFFFFFFFF, 2 * size
    out = out[: len(c) - k + 1]
    out = out ^ (out >> U(29))
    return (out * U(0xD6E8FEB86659FD93)) >> U(32)


def winnow(c: np.ndarray, k: int = GRAM, w: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the marks, by position. A text shorter than k is one gram; an empty one has none."""
    n = len(c)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    grams = gram_hashes(c, min(k, n))
    kept = grams << U(32) | (LOW - np.arange(len(grams), dtype=U))  # of equal hashes the rightmost is the smallest
    w, size = min(w, len(kept)), 1
    while 2 * size <= w:
        kept, size = np.minimum(kept[:-size], kept[size:]), 2 * size
    if size < w:
        kept = np.minimum(kept[: len(kept) - (w - size)], kept[w - size :])
    marks = kept[np.concatenate([[True], kept[1:] != kept[:-1]])]
    return (marks >> U(32)).astype(np.uint32), (LOW - (marks & LOW)).astype(np.int64)


def signature(hashes: np.ndarray) -> str:
    """The distinct marks, 8 hexadecimal digits each, in ascending order."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sets of distinct marks; 1 if both are empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(a) + len(b) - shared)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, hashes and positions (arrays) of the marks of every whole text. Null and empty texts have none."""
    tune(docs.sparkSession)

    def run(source):
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                marks = [winnow(code_points(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([h.astype(np.int64) for h, _ in marks], pa.list_(pa.int64())), pa.array([p for _, p in marks], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_marks long, positions array<int>"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(source):
    """Rows arrive by stretch and in order; a row is done when its successor is known."""
    out: list[tuple] = []
    waiting = stretch = None

    def done(doc, text, own, places, following, after):
        new = edited(text, following)
        marks = np.unique(winnow(code_points(new))[0])
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), signature(own), signature(marks), likeness(own, marks), likeness(own, after), len(own), places

    def flush():
        columns = list(zip(*out)) or [()] * 9
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int32()))
        names = [c.split()[0] for c in COMPARED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    for batch in source:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            for doc, text, b, ahead in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "stretch", "ahead"))):
                if b != stretch:
                    waiting, stretch = None, b
                elif waiting is None:
                    continue  # the stretch is complete: rows of the next one that share the id of its first
                text = text or ""
                hashes, places = winnow(code_points(text))
                own = np.unique(hashes)
                if waiting is not None:
                    out.append(done(*waiting, text, own))
                waiting = None if ahead else (doc, text, own, places.astype(np.int32))
            yield flush()
            out = []


def stretcher(docs: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """A function that adds _h (the hash of a text) and stretch, a struct that falls in the order of rows; there are about n of them."""
    found, rows, null = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n), F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    bounds = [-float("inf"), *sorted({float(x) + 0.5 for x in found or []} or {0.5}), float("inf")]
    cut = Bucketizer(splits=bounds, inputCol="_id", outputCol="_b", handleInvalid="keep")
    # pieces of an id: stretches fall as ids do and, within an id, as the hash rises
    hot = {x: k for x, k in Counter(found or []).items() if k > 1}
    pieces = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for x, k in hot.items() for v in (x, k)]), F.col("doc_id")), F.lit(1)) if hot else F.lit(1)
    pieces = F.when(F.col("doc_id").isNull(), F.lit(1 + n * null // max(rows, 1))).otherwise(pieces)
    unit = F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 11) / float(1 << 53)

    def with_stretch(df):
        placed = cut.transform(df.withColumn("_id", F.col("doc_id").cast("double")).withColumn("_h", F.xxhash64("text")))
        major = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_b").cast("int"))
        minor = F.least(F.floor(unit * pieces), pieces - 1)
        # a hot id shares its bucket with lower ids, which come behind all of its pieces
        return placed.withColumn("stretch", F.struct(major.alias("b"), F.when(pieces > 1, F.lit(1)).otherwise(0).alias("hot"), (-minor).cast("int").alias("m"))).drop("_id", "_b")

    return with_stretch


def compare_with_edits(docs: DataFrame, stretches: int | None = None) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document, in descending doc_id.

    The edited text has its last half (rounded down, in code points) replaced by as many of the first code points of
    the next document, or all it has; after the last document comes the first. positions are those of the marks in the
    text, ascending: any passage of GRAM + SPAN - 1 code points has a mark that starts within it. Texts are whole; null
    counts as empty. Null doc_ids come last; among repeated doc_ids the order is that of a hash of the text. A single
    row follows itself. Extra columns are ignored and an empty table gives none.

    Ids are cut into stretches at quantiles. An id that several quantiles fall on, as one that a third of all rows
    share, is cut into as many stretches by the hash of its texts (null ids as well); only rows that agree in id and
    text stay together. The first row of a stretch is also sent to the one before it, so texts are moved once and a
    task holds about a stretch's share of the rows. The driver gets a row for each stretch.
    """
    spark = docs.sparkSession
    tune(spark)
    with_stretch = stretcher(docs, stretches or 3 * max(4, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    last = F.struct("doc_id", (-F.col("_h").cast("decimal(20,0)")).alias("h"))
    ends = with_stretch(docs.select("doc_id", "text")).groupBy("stretch").agg(F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), last.alias("k"))).alias("f")).collect()
    firsts = sorted(((tuple(r[0]), r[1]["k"]["doc_id"], -int(r[1]["k"]["h"])) for r in ends), key=lambda r: r[0], reverse=True)
    before = [(doc, h, *firsts[i - 1][0]) for i, (_, doc, h) in enumerate(firsts)]  # the first row of all goes to the last stretch
    heads = spark.createDataFrame(before, "_head long, _hash long, _to_b int, _to_hot int, _to_m int")  # a row for each stretch
    placed = with_stretch(docs.select("doc_id", "text"))
    sent = placed.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_head")) & (F.col("_h") == F.col("_hash")), "left")
    here = F.struct("stretch", F.lit(0).alias("ahead"))
    there = F.struct(F.struct(F.col("_to_b").alias("b"), F.col("_to_hot").alias("hot"), F.col("_to_m").alias("m")).alias("stretch"), F.lit(1).alias("ahead"))
    sent = sent.select("doc_id", "text", "_h", F.explode(F.when(F.col("_to_b").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_d")).select("doc_id", "text", "_h", "_d.*")
    order = ["stretch", "ahead", F.col("doc_id").desc_nulls_last(), "_h"]
    flat = F.concat_ws(":", "stretch.b", "stretch.hot", "stretch.m")
    return sent.repartition("stretch").sortWithinPartitions(*order).select("doc_id", "text", flat.alias("stretch"), "ahead").mapInArrow(_compare, COMPARED)
