"""Best-fit packing in bulk-synchronous rounds (operator 5).

Documents go in classes of falling length. A round of a class has sweeps: its documents and the gaps of open sequences,
sorted by falling size, are read as brackets, a gap as an opening one and a document as a closing one. A document's
successor is the gap that it closes: the tightest one that no longer document took. Running sums give each bracket its
depth; a gap and its document have the same depth and stand next to each other there. So the place in the order (rank)
settles which of the documents that want the same gap gets it. Gaps are updated, and what didn't fit is swept again.
If nothing fits, as many sequences are opened as the documents that are left need at least.

A sweep is one exchange into cells of bounded size, in which documents and gaps are sorted and matched by windows;
cells are drawn anew for every sweep, so that what is left meets other gaps. The driver sees a few totals for each.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from tidewater.llm.common import free_name, let_go, materialize, release, tune
from tidewater.llm.wordpieces import library_encoder

WAITING, GAP, PLACED = 0, 1, 2
#: A sweep that places less than this share of what waits is followed by new sequences; the second one is for the shortest class.
FEW, FEW_SHORT = 2 / 3, 1 / 4
#: Documents and places that one cell of a sweep holds on average. Cells are dealt out anew in every sweep.
CELL = 1 << 15


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, memory: int = 500_000, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids with end_id appended; with_ids: and the ids themselves.

    A document of more than capacity ids is cut into pieces of exactly capacity, the remainder being the first. Null
    and empty texts have end_id alone. Repeated rows have pieces each.
    """
    tune(docs.sparkSession)
    end = int(end_id).to_bytes(4, "little")

    def run(source):
        enc = library_encoder(vocabulary, memory)
        for batch in source:
            for at in range(0, batch.num_rows, 1500):
                part, rows, streams = batch.slice(at, 1500), [], []
                for doc, ids in zip(part.column("doc_id").to_pylist(), enc.encode_array(part.column("text"))):
                    ids += end
                    n = len(ids) // 4
                    first = n % capacity or min(n, capacity)
                    cuts = [0, *range(first, n + 1, capacity)]
                    streams.append(ids)
                    rows += [(doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(columns[3].to_numpy())]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(streams), "<i4")))
                yield pa.RecordBatch.from_arrays(columns, names)
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def classes(capacity: int) -> list[tuple[int, int]]:
    """Ranges (above, up to) of lengths, longest first: those of which one, two, three fit in a sequence, then halves."""
    bounds = sorted({max(1, capacity // k) for k in (1, 2, 3, 4, 8, 16)} | {0}, reverse=True)
    return list(zip(bounds[1:], bounds))


#: States are rows of kind, row, sequence_id, size and offset: a waiting document has no sequence, a gap has no row, and its
#: size is what is left. A gap of at least `upto` takes as many documents as surely fit, another one takes one.
STATE = "kind int, row long, sequence_id long, size long, offset long"

#: A bracket's depth is the running sum less the least sum so far below 0; a document closes the depth that stood before it.
SWEEP = """
WITH items AS (
  SELECT kind, row, sequence_id, size, coalesce(row, sequence_id) AS id, slot, pmod(xxhash64({number}, coalesce(row, sequence_id)), {cells}) AS cell
  FROM {state} LATERAL VIEW explode(sequence(1, if(kind = 1, greatest(1, int(size / {upto})), 1))) AS slot
), summed AS (
  SELECT *, sum(if(kind = 1, 1, -1)) OVER (PARTITION BY cell ORDER BY size DESC, kind DESC, id, slot ROWS UNBOUNDED PRECEDING) AS total FROM items
), lowest AS (
  SELECT *, least(0, min(total) OVER (PARTITION BY cell ORDER BY size DESC, kind DESC, id, slot ROWS UNBOUNDED PRECEDING)) AS low,
    least(0, min(total) OVER (PARTITION BY cell ORDER BY size DESC, kind DESC, id, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS low_before FROM summed
), deep AS (
  SELECT *, if(kind = 1, total - low, total + 1 - coalesce(low_before, 0)) AS depth FROM lowest
), taken AS (
  SELECT *, if(kind = 0 AND depth > 0, lag(struct(sequence_id AS id, size AS gap)) OVER (PARTITION BY cell, depth ORDER BY size DESC, kind DESC), NULL) AS took FROM deep
), put AS (
  SELECT cell, if(took IS NULL, kind, 2) AS kind, row, coalesce(took.id, sequence_id) AS sequence_id, size, slot, depth, took.gap AS gap FROM taken
), filled AS (
  SELECT *, sum(if(kind = 2, size, 0)) OVER (PARTITION BY cell, sequence_id) AS used, sum(if(kind = 2, size, 0)) OVER (PARTITION BY cell, sequence_id ORDER BY kind, depth ROWS UNBOUNDED PRECEDING) AS upto_here FROM put
)
SELECT kind, row, sequence_id, if(kind = 1, size - used, size) AS size, if(kind = 2, {capacity} - gap + upto_here - size, NULL) AS offset FROM filled
WHERE slot = 1 AND (kind <> 1 OR size > used)
"""

TOTALS = {
    "waiting": "count(CASE WHEN kind = 0 THEN 1 END)",
    "volume": "sum(CASE WHEN kind = 0 THEN size END)",
    "shortest": "min(CASE WHEN kind = 0 THEN size END)",
    "widest": "max(CASE WHEN kind = 1 THEN size END)",
    "places": "sum(CASE WHEN kind = 1 THEN greatest(1, int(size / {upto})) END)",
}


def sweep(state: DataFrame, upto: int, capacity: int, cells: int, number: int) -> DataFrame:
    """The state after a sweep of documents of at most `upto`, in so many cells; placed documents (kind 2) have a sequence and an offset.

    Documents and gaps meet in cells that a hash deals out anew in every sweep; everything after that exchange is
    windows in a cell.
    """
    return state.sparkSession.sql(SWEEP, state=state, upto=upto, capacity=capacity, cells=cells, number=number)


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces with sequence_id and offset (gapless from 0 in each sequence), earlier columns of these names replaced.

    pieces: a written table with length from 1 to capacity; a length outside, or null, raises an error. Repeated rows
    are packed each; extra columns are kept; an empty table stays empty. Rows are numbered when they are written, so
    equal ones are dealt out like any others. The driver gets a few totals for each sweep, which are taken while the sweep before it is written.
    """
    spark = pieces.sparkSession
    row = free_name(pieces.columns, "_row")
    held = materialize(pieces.drop("sequence_id", "offset").withColumn(row, F.monotonically_increasing_id()), "pieces")
    size, nothing = F.col("length").cast("long"), F.lit(None).cast("long")
    if held.filter(F.coalesce((size < 1) | (size > capacity), F.lit(True))).count():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    gaps, done, opened, number = spark.createDataFrame([], STATE), [], 0, 0
    for above, upto in classes(capacity):
        docs = held.filter((size > above) & (size <= upto)).select(F.lit(WAITING).alias("kind"), F.col(row).alias("row"), nothing.alias("sequence_id"), size.alias("size"), nothing.alias("offset"))
        if 2 * (above + 1) > capacity:  # no two of them fit in a sequence: each opens its own, named by its row
            done.append(docs.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
            own = docs.select(F.lit(GAP).alias("kind"), nothing.alias("row"), F.col("row").alias("sequence_id"), (capacity - F.col("size")).alias("size"), nothing.alias("offset"))
            gaps = gaps.unionByName(own.filter("size > 0"))
            continue
        small, state, before = gaps.filter(F.col("size") <= above), gaps.filter(F.col("size") > above).unionByName(docs), None
        totals = [F.expr(x.format(upto=upto)).alias(name) for name, x in TOTALS.items()]
        now = state.agg(*totals).first().asDict()
        while now["waiting"]:
            waiting, volume, shortest, widest, places = (now[name] for name in TOTALS)
            need = 0
            if (widest or 0) < shortest or (before and before - waiting < (FEW if above else FEW_SHORT) * before):
                need = max(-(-volume // capacity), -(-waiting // (capacity // (above + 1))))
                new = spark.range(opened + 1, opened + need + 1).select(F.lit(GAP).alias("kind"), nothing.alias("row"), (-F.col("id")).alias("sequence_id"), F.lit(capacity).cast("long").alias("size"), nothing.alias("offset"))
                state, opened = state.unionByName(new), opened + need
            cells = -(-(waiting + (places or 0) + need * (capacity // upto)) // CELL)
            seen = Observation()
            after, number = materialize(sweep(state, upto, capacity, cells, number).observe(seen, *totals), "sweep"), number + 1
            done.append(after.filter(f"kind = {PLACED}").select("row", "sequence_id", "offset"))
            state, before, now = after.filter(f"kind <> {PLACED}"), waiting, seen.get
            let_go(spark)
        gaps = small.unionByName(state)
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return held.join(placed.withColumnRenamed("row", row), row).drop(row)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, capacity: int = 1024, memory: int = 500_000, with_ids: bool = False) -> DataFrame:
    """Cut and pack all documents; see cut_pieces and pack. memory: pieces of text whose ids a worker keeps."""
    return pack(cut_pieces(docs, vocabulary, end_id, capacity, memory, with_ids), capacity)
