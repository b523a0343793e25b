"""Token ids in a content-addressed store (operator 1).

Layout below a path: chunks/ (digest, payload), each distinct chunk once; recipes/ (entry, part, doc_id, n_tokens,
digests, tails, root) in ascending doc_id order; manifest/ (part, first_doc, n_docs, n_tokens, start, root). A chunk
ends where a rolling hash of the last 16 ids has its low bits zero, so equal passages give equal chunks whatever
precedes them. root is the Merkle root of a document's chunk digests; a part's root is that of its documents' roots.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, release, remove, tune
from tidewater.llm.wordpieces import library_encoder

WINDOW, SHORTEST, LONGEST, MASK = 16, 64, 2048, 255
DIGEST = 16
#: Texts that are encoded and cut at a time: what a worker holds beside its batch.
ROWS = 500
#: Pieces of text whose ids a worker keeps in each of two generations.
KEPT = 700_000
#: Ids shrink by 4 % more at the default level, which takes a third more time; values of a table of chunks hardly repeat.
PLAIN = {"compression": "zstd", "parquet.compression.codec.zstd.level": "2", "parquet.enable.dictionary": "false"}
#: A staging task writes a chunk once, as long as it has not met so many different ones since.
SENT = 1 << 18


def _mix(ids: np.ndarray) -> np.ndarray:
    """A 64-bit number for each id, by multiplication and shifts."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cut_points(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Where the chunks of each sequence end. starts: where the sequences in ids start, with len(ids) last."""
    rolled = _mix(ids)
    step = 1
    while step < WINDOW:  # the hash of a window is put together from its halves
        longer = rolled.copy()
        longer[step:] += rolled[:-step] << np.uint64(step) if len(rolled) > step else np.uint64(0)
        rolled, step = longer, 2 * step
    marks = np.flatnonzero((rolled >> np.uint64(20)) & np.uint64(MASK) == 0) + 1
    bounds = np.searchsorted(marks, starts)
    marked, out = marks.tolist(), []
    for a, b, lo, hi in zip(starts.tolist(), starts[1:].tolist(), bounds.tolist(), bounds[1:].tolist()):
        ends, last = [], a
        for m in [*marked[lo:hi], b]:
            while m - last > LONGEST:
                last += LONGEST
                ends.append(last)
            if m - last >= SHORTEST or (m == b and m > last):
                ends.append(m)
                last = m
        out.append(ends)
    return out


def digest(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:DIGEST]


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged; no leaf: the digest of nothing."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class CrcShift:
    """CRC-32 of joined parts from the parts' own: a part's CRC is moved over the bytes that follow it, and all are XORed."""

    def __init__(self):
        one = [1 << i for i in range(32)]
        for _ in range(8):
            one = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in one]
        self.tables = []
        columns = np.array(one, np.uint32)
        for _ in range(48):  # the move over 2^k bytes
            table = np.zeros((4, 256), np.uint32)
            for byte in range(4):
                for bit in range(8):
                    has = np.arange(256) >> bit & 1 == 1
                    table[byte, has] ^= columns[8 * byte + bit]
            self.tables.append(table)
            columns = self._apply(table, columns)

    @staticmethod
    def _apply(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        return t[0, v & 255] ^ t[1, v >> 8 & 255] ^ t[2, v >> 16 & 255] ^ t[3, v >> 24]

    def __call__(self, crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        crc, k, left = crc.astype(np.uint32), 0, n_bytes.astype(np.int64)
        while left.any():
            on = np.flatnonzero(left & 1)
            crc[on] = self._apply(self.tables[k], crc[on])
            left, k = left >> 1, k + 1
        return crc


STAGED = "kind int, doc_id long, n_tokens long, digest binary, payload binary, digests array<binary>, tails array<long>, root binary"


def _stage(vocabulary: str, end_id: int, width: int):
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("payload", pa.binary()), ("digests", pa.list_(pa.binary())), ("tails", pa.list_(pa.int64())), ("root", pa.binary())])
    end = int(end_id).to_bytes(4, "little")

    def recipes(enc, part, chunks, sent):
        """Recipes of the texts of part; chunks whose digests aren't among sent are added to chunks."""
        streams = [i + end for i in enc.encode_array(part.column("text"))]
        ids = np.frombuffer(b"".join(streams), "<u4")
        if len(ids) and int(ids.max()) >> (8 * width):
            raise ValueError(f"an id doesn't fit in {width} bytes")
        starts = np.concatenate([[0], np.cumsum([len(s) // 4 for s in streams])]).astype(np.int64)
        packed = ids.astype(f"<u{width}").tobytes()
        digests, tails, roots = [], [], []
        for a, b, ends in zip(starts.tolist(), starts[1:].tolist(), cut_points(ids, starts)):
            mine = []
            for x, y in zip([a, *ends], ends):
                payload = packed[x * width : y * width]
                d = digest(payload)
                if d not in sent:
                    sent.add(d)
                    chunks[d] = payload
                mine.append(d)
            digests.append(mine)
            tails.append([b - y for y in ends])
            roots.append(merkle(mine))
        n = len(streams)
        return pa.RecordBatch.from_arrays([pa.array([0] * n, pa.int32()), part.column("doc_id").cast(pa.int64()), pa.array(np.diff(starts)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(digests, schema.field("digests").type), pa.array(tails, schema.field("tails").type), pa.array(roots, pa.binary())], schema=schema)

    def run(source):
        enc = library_encoder(vocabulary, KEPT)
        sent: set[bytes] = set()
        for batch in source:
            chunks: dict[bytes, bytes] = {}
            for at in range(0, batch.num_rows, ROWS):
                yield recipes(enc, batch.slice(at, ROWS), chunks, sent)
            if len(sent) > SENT:
                sent.clear()
            m = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(list(chunks), pa.binary()), pa.array(list(chunks.values()), pa.binary()), *(pa.nulls(m, schema.field(k).type) for k in ("digests", "tails", "root"))], schema=schema)
        release()

    return run


def part_roots(recipes: DataFrame) -> DataFrame:
    """part, first_doc, n_docs, n_tokens, root (the Merkle root of its documents' roots, in their order) and start (ids before it) of every part."""
    def roots(source):
        part, leaves = None, []
        for batch in source:
            for p, root in zip(batch.column("part").to_pylist(), batch.column("root").to_pylist()):
                if p != part and leaves:
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "root": pa.array([merkle(leaves)], pa.binary())})
                    leaves = []
                part = p
                leaves.append(root)
        if leaves:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "root": pa.array([merkle(leaves)], pa.binary())})

    tree = recipes.select("part", "entry", "root").repartition("part").sortWithinPartitions("part", "entry").select("part", "root").mapInArrow(roots, "part int, root binary")
    sums = recipes.groupBy("part").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    return sums.join(tree, "part").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, width: int = 2) -> None:
    """Encode every whole text, append end_id to each, and write the store below path.

    width: bytes of a stored id (2 for vocabularies below 65,536, else 4). Null and empty texts have end_id alone.
    Repeated rows and repeated doc_ids have an entry each, in any order among equal ids; null doc_ids come first.
    Extra columns are ignored. An empty table gives an empty store. Tasks stage a chunk once, so that a text that fills
    a third of the table is sent once by each; a shuffle by digest then makes chunks unique.
    """
    spark = docs.sparkSession
    tune(spark)
    docs.select("doc_id", "text").mapInArrow(_stage(vocabulary, end_id, width), STAGED).write.options(**PLAIN).parquet(f"{path}/staged")
    staged = spark.read.schema(STAGED).parquet(f"{path}/staged")
    chunks = staged.filter("kind = 1").select("digest", "payload").repartition("digest").dropDuplicates(["digest"])
    chunks.write.options(**PLAIN).parquet(f"{path}/chunks")
    recipes = staged.filter("kind = 0").select("doc_id", "n_tokens", "digests", "tails", "root")
    order = [F.col("doc_id").asc_nulls_first(), F.col("root")]  # the root deals out rows that share an id
    placed = recipes.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select(F.monotonically_increasing_id().alias("entry"), F.spark_partition_id().alias("part"), "*")
    placed = materialize(placed, "recipes", f"{path}/recipes")
    remove(spark, f"{path}/staged")

    part_roots(placed).write.parquet(f"{path}/manifest")


def read_index(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, merkle_root of every document, from the files.

    Nothing is taken on trust: every stored chunk is read once and held against its digest; every document's root is
    computed anew from its digests in their order, every part's root from those of its documents; places, lengths and
    chunk sizes have to agree with each other. So recipes are known to be what was written, and a document's checksum
    is put together from those of its chunks. A chunk that is missing or differs, a recipe or a manifest that was
    changed raises an error.
    """
    def check(source):
        for batch in source:
            payload = batch.column("payload").cast(pa.large_binary())
            if not len(payload):
                continue
            ends = np.frombuffer(payload.buffers()[1], np.int64)[payload.offset : payload.offset + len(payload) + 1]
            data, bounds = memoryview(payload.buffers()[2]), ends.tolist()
            for d, x, y in zip(batch.column("digest").to_pylist(), bounds, bounds[1:]):
                if digest(data[x:y]) != d:
                    raise ValueError("a stored chunk differs from its digest")
            ids = memoryview(np.frombuffer(data[bounds[0] : bounds[-1]], f"<u{width}").astype("<u4")).cast("B")
            places = ((ends - ends[0]) // width * 4).tolist()
            crcs = [zlib.crc32(ids[x:y]) for x, y in zip(places, places[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(np.diff(ends) // width), pa.array(crcs, pa.int64())], ["digest", "size", "crc"])

    def move(source):
        shift = CrcShift()
        for batch in source:
            crc = shift(batch.column("crc").to_numpy(), 4 * batch.column("tail").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("entry"), batch.column("size"), pa.array(crc.astype(np.int64))], ["entry", "size", "moved"])

    def sound(source):
        for batch in source:
            for root, digests, tails, n in zip(*(batch.column(c).to_pylist() for c in ("root", "digests", "tails", "n_tokens"))):
                ends = [n, *tails]
                if merkle(digests) != root or len(digests) != len(tails) or ends[-1] != 0 or any(a <= b for a, b in zip(ends, ends[1:])):
                    raise ValueError("a recipe differs from its Merkle root")
            count, tail = np.diff(batch.column("tails").offsets.to_numpy()), batch.column("tails").flatten().to_numpy()
            begin = np.concatenate([tail[:1], tail[:-1]])  # ids from the chunk before to the document's end
            begin[(np.cumsum(count) - count)[count > 0]] = batch.column("n_tokens").to_numpy()[count > 0]
            entry = np.repeat(batch.column("entry").to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(entry), batch.column("digests").flatten(), pa.array(tail), pa.array(begin - tail)], ["entry", "digest", "tail", "want"])

    stored = spark.read.parquet(f"{path}/recipes")
    parts = stored.select("entry", "n_tokens", "digests", "tails", "root").mapInArrow(sound, "entry long, digest binary, tail long, want long")
    chunks = spark.read.parquet(f"{path}/chunks").mapInArrow(check, "digest binary, size long, crc long")
    joined = parts.join(chunks.hint("shuffle_hash"), "digest").filter("size = want").select("entry", "tail", "size", "crc").mapInArrow(move, "entry long, size long, moved long")
    whole = joined.groupBy("entry").agg(F.bit_xor("moved").alias("ids_crc32"), F.sum("size").alias("got"), F.count(F.lit(1)).alias("n_chunks"))
    own = stored.select("entry", "part", "doc_id", "n_tokens", F.size("digests").alias("want"), F.hex("root").alias("merkle_root"))
    before = Window.partitionBy("part").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    found = part_roots(stored).select("part", "n_docs", "n_tokens", "root", "start", F.lit(True).alias("_found"))
    claimed = spark.read.parquet(f"{path}/manifest").select("part", "n_docs", "n_tokens", "root", "start", F.lit(True).alias("_claimed"))
    held = found.join(claimed, ["part", "n_docs", "n_tokens", "root", "start"], "full")
    agrees = F.coalesce(F.col("_claimed") & F.col("_found"), F.lit(False))
    starts = held.select("part", F.when(agrees, F.col("start")).otherwise(F.raise_error(F.lit("a part differs from the manifest")).cast("long")).alias("_start"))
    out = own.join(starts, "part", "full").join(whole, "entry", "left")
    right = (F.col("got") == F.col("n_tokens")) & (F.col("n_chunks") == F.col("want"))
    crc = F.when(F.coalesce(right, F.lit(False)), F.col("ids_crc32")).otherwise(F.raise_error(F.lit("a document can't be put together from its chunks")).cast("long"))
    return out.select("doc_id", (F.col("_start") + F.col("_before")).cast("long").alias("start"), "n_tokens", crc.alias("ids_crc32"), "n_chunks", "merkle_root")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array of int) of every document, put together from its chunks, each recipe held against its Merkle root.

    Repeated ids and rows come out each, a null doc_id stays null, and an empty store gives none.
    """
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("entry", F.posexplode("digests").alias("at", "digest"))
    filled = parts.join(spark.read.parquet(f"{path}/chunks"), "digest")
    lists = filled.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("at", "digest", "payload"))).alias("chunks"))
    joined = recipes.select("entry", "doc_id", "root").join(lists, "entry", "left").select("doc_id", "root", "chunks.digest", "chunks.payload")

    def run(source):
        for batch in source:
            ids = []
            for root, found, payload in zip(batch.column("root").to_pylist(), batch.column("digest").to_pylist(), batch.column("payload").to_pylist()):
                if merkle(found or []) != root or any(digest(p) != d for p, d in zip(payload or [], found or [])):
                    raise ValueError("a document differs from its Merkle root")
                ids.append(np.frombuffer(b"".join(payload or []), f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return joined.mapInArrow(run, "doc_id long, ids array<int>")
