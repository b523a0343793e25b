"""Links between texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8, none missed.

Prefix filtering: if the shingles of all texts are put in one order, two texts of similarity s share a shingle among the
first n - ceil(s n) + 1 of each. Shingles seen often stand last in the order, so passages that many texts share
hardly ever bring two of them together. Every candidate is checked on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import discard, let_go, materialize, release
from tidewater.llm.components import components

SEED = 42
WIDTH = 5
#: The least similarity of linked texts, as a fraction: 4 / 5.
PARTS, WHOLE = 4, 5
#: Larger buckets are first held against one of their texts, and then compared in cells of about so many.
SMALL, CELL = 16, 2048
#: A part of a cell has about so many shingles, as cells hold whole sets; pairs are looked at in blocks of about so many.
CELL_SHINGLES, BLOCK = 1 << 20, 1 << 18
#: Rounds in which texts of a large bucket are held against its largest group before all of its pairs are.
STRAY_ROUNDS = 1
#: A shingle in so many texts of a batch is reported; so many reported ones at most are put last. Neither changes the links.
SEEN, COMMON = 2, 1 << 18
#: Places of the filter by which the texts of candidates are picked out before they are shuffled.
FILTER_BITS = 24

U = np.uint64


def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of the whole sequence if it is shorter; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], U)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-width])]
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], U)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def _texts(batch):
    """Mark and shingle set of a batch's texts, each once."""
    done = set()
    for at in range(0, batch.num_rows, 500):
        part = batch.slice(at, 500)
        for mark, text in zip(part.column("mark").to_pylist(), part.column("text").to_pylist()):
            if mark not in done:
                done.add(mark)
                yield mark, shingle_set(text)


def common_shingles(marked: DataFrame) -> np.ndarray:
    """Hashes of shingles that stand in many texts, rarer ones first."""
    def run(source):
        for batch in source:
            sets = [s for _, s in _texts(batch)]
            if sets:
                found, n = np.unique(np.concatenate(sets), return_counts=True)
                many = n >= SEEN
                yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(n[many].astype(np.int64))], ["key", "n"])
        release()

    seen = marked.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = seen.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    return rows.column("key").to_numpy()[::-1].copy().view(U)


def prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all: the uncommon ones by hash, then the common ones, rarer ones first.

    common: ascending hashes; rank: the place of each among the common ones.
    """
    n = len(shingles)
    place = np.full(n, -1, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        place = np.where(common[at] == shingles, rank[at], -1)
    return shingles[np.argsort(place, kind="stable")][: n - -(-PARTS * n // WHOLE) + 1]


def prefixes(marked: DataFrame) -> DataFrame:
    """key, mark, n (shingles of the text) and pos of every shingle in a text's prefix; a text may come more than once."""
    order = common_shingles(marked)
    by_hash = np.argsort(order)
    shared = marked.sparkSession.sparkContext.broadcast((order[by_hash], by_hash))

    def run(source):
        common, rank = shared.value
        for batch in source:
            marks, sizes, firsts = [], [], []
            for mark, s in _texts(batch):
                if len(s):
                    marks.append(mark)
                    sizes.append(len(s))
                    firsts.append(prefix(s, common, rank))
            if marks:
                n = [len(f) for f in firsts]
                columns = [np.concatenate(firsts).view(np.int64), np.repeat(np.array(marks, np.int64), n), np.repeat(np.array(sizes, np.int32), n), np.concatenate([np.arange(k, dtype=np.int32) for k in n])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "mark", "n", "pos"])
        release()

    return marked.mapInArrow(run, "key long, mark long, n int, pos int")


def _may_link(n, pos, a, b) -> np.ndarray:
    """Whether sizes and places in the prefixes leave room for the similarity, if the shared shingle is the pair's first."""
    return _room(n[a], pos[a], n[b], pos[b])


def _room(n, pos, m, at) -> np.ndarray:
    return (PARTS + WHOLE) * np.minimum(n - pos, m - at) >= PARTS * (n + m)


def _small_and_first(source):
    """Of buckets sorted by key and mark: all pairs of small ones; of larger ones every text with the first, and the rows to compare later (b null)."""
    names = ["a", "b", "key", "n", "pos"]
    held = tuple(np.zeros(0, np.int64) for _ in range(4))
    first = None  # key and first row of a larger bucket whose start is gone

    def pairs(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], names)

    def compare(key, mark, n, pos):
        if not len(key):
            return
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])])
        key, mark, n, pos = key[new], mark[new], n[new], pos[new]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        large = sizes > SMALL
        lead = [mark[starts], n[starts], pos[starts]]
        if first is not None and key[0] == first[0]:
            large[0] = True
            for x, y in zip(lead, first[1:]):
                x[0] = y
        of = np.repeat(np.arange(len(sizes)), sizes)
        ends = starts + sizes
        for step in range(1, SMALL):
            a = np.flatnonzero(~large[of] & (np.arange(len(key)) + step < ends[of]))
            if not len(a):
                break
            a = a[_may_link(n, pos, a, a + step)]
            yield pairs(mark[a], mark[a + step])
        rows = np.flatnonzero(large[of])
        if len(rows):
            one, size, place = (x[of[rows]] for x in lead)
            fit = (one != mark[rows]) & _room(size, place, n[rows], pos[rows])
            yield pairs(one[fit], mark[rows[fit]])
            yield pa.RecordBatch.from_arrays([pa.array(mark[rows]), pa.nulls(len(rows), pa.int64()), pa.array(key[rows]), pa.array(n[rows]), pa.array(pos[rows])], names)

    for batch in source:
        if not batch.num_rows:
            continue
        held = tuple(np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("key", "mark", "n", "pos")))
        cut = int(np.searchsorted(held[0], held[0][-1]))
        yield from compare(*(x[:cut] for x in held))
        held = tuple(x[cut:] for x in held)
        if len(held[0]) > CELL and len(np.unique(held[1])) > SMALL:
            yield from compare(*held)
            if first is None or first[0] != held[0][0]:
                first = tuple(x[0] for x in held)
            held = tuple(x[:0] for x in held)
    yield from compare(*held)
    release()


def _by_cell(source):
    """The rows of each cell as one table, from batches sorted by cell."""
    held = []
    for batch in source:
        cell = batch.column("cell").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for at, to in zip(cuts, cuts[1:]) if len(cell) else ():
            if held and held[0].column("cell")[0].as_py() != cell[at]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held)


def _possible(mark, root, n, pos, side, words):
    """Pairs of rows of a cell that may link, each once, as arrays by blocks of rows; a text of side 0 meets those of side 1, or of side 0 where there is none.

    Texts of one root are connected already. Sets differ in as many shingles as their sketches differ in bits at least, which rules out most pairs for sure.
    """
    two = (side == 1).any()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(mark)),) * 2
    step = max(1, BLOCK // max(1, len(right)))
    for at in range(0, len(left), step):
        x = left[at : at + step, None]
        keep = (root[x] != root[right]) & (mark[x] != mark[right]) & _may_link(n, pos, x, right)
        i, j = np.nonzero(keep if two else keep & (x < right))
        a, b = left[at + i], right[j]
        apart = sum(np.bitwise_count(w[a] ^ w[b]).astype(np.int64) for w in words)
        near = (PARTS + WHOLE) * apart <= (WHOLE - PARTS) * (n[a] + n[b])
        yield a[near], b[near]


def _rows_with_partners(source):
    """Those rows of each cell that may link with another one of it, without their sketches."""
    for cell in _by_cell(source):
        columns = [cell.column(c).to_numpy() for c in PLACED[1:]]
        keep = np.zeros(cell.num_rows, bool)
        for a, b in _possible(*columns, [cell.column(c).to_numpy().view(U) for c in SKETCH]):
            keep[a] = keep[b] = True
        yield from cell.select(PLACED).filter(pa.array(keep)).to_batches()
    release()


def _spanning(source):
    """Links (a, b) that connect all texts of a cell that its links connect: fewer than it has texts, each checked on the whole sets.

    A pair that links found before connect isn't checked.
    """
    for cell in _by_cell(source):
        mark, root, n, pos, side = (cell.column(c).to_numpy() for c in PLACED[1:])
        sets = [np.frombuffer(x.as_buffer(), U) for x in cell.column("shingles")]
        words = [w.copy() for w in np.array([sketch(s) for s in sets], np.int64).T.view(U)]
        group, found = np.unique(root, return_inverse=True)[1], []
        for a, b in _possible(mark, root, n, pos, side, words):
            starts = np.flatnonzero(np.diff(a, prepend=-1))
            for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(a)]):
                one, others = int(a[at]), b[at:to]
                others = others[group[others] != group[one]]
                if not len(others):
                    continue
                own, theirs = sets[one], np.concatenate([sets[k] for k in others.tolist()])
                hits = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                both = np.add.reduceat(hits.astype(np.int64), np.cumsum([0, *n[others[:-1]].tolist()]))
                for k in others[WHOLE * both >= PARTS * (n[one] + n[others] - both)].tolist():
                    if group[k] != group[one]:
                        group[group == group[k]] = group[one]
                        found.append((mark[one], mark[k]))
        if found:
            x, y = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
    release()


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = rows.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    return materialize(known.dropDuplicates(["key", "mark"]), "buckets")


def stray_pairs(rows: DataFrame, roots: DataFrame, salt: int = 0) -> DataFrame:
    """Candidates (a, b) of each text with one of the largest group of its bucket, another one in each bucket.

    They are as many as rows at most. What they link needs no comparison of all pairs.
    """
    known = with_roots(rows, roots)
    groups = known.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("key", "mark", F.lit(salt)), "mark", "n", "pos")).alias("one"))
    largest = groups.groupBy("key").agg(F.max(F.struct("size", "root", "one")).alias("g")).select("key", "g.root", "g.one").withColumnRenamed("root", "_root")
    strays = known.join(largest, "key").filter("root <> _root")
    most = F.least(F.col("n") - F.col("pos"), F.col("one.n") - F.col("one.pos"))
    fit = strays.filter((PARTS + WHOLE) * most >= PARTS * (F.col("n") + F.col("one.n")))
    return fit.select(F.least("mark", "one.mark").alias("a"), F.greatest("mark", "one.mark").alias("b")).distinct()


def cross_pairs(rows: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the links of the larger buckets connect, of texts that aren't connected yet.

    rows: key, mark, n, pos; roots: node and root; marked: mark and text. A bucket of c cells' worth of texts or
    shingles is dealt out to c (c + 1) / 2 cells. A cell first names its texts that may link by their sketches; only
    these get their sets, and the cell checks the pairs and gives fewer links than it has texts.
    """
    known = with_roots(rows, roots)
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / CELL), F.ceil(F.sum("n") / CELL_SHINGLES)).cast("long")
    mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), parts.alias("parts")).filter("lo < hi").select("key", "parts")
    left = materialize(known.join(mixed, "key"), "mixed")
    dealt = left.join(picked(left, marked, sketch, ", ".join(f"{c} long" for c in SKETCH)), "mark").withColumn("part", F.pmod(F.xxhash64("mark", "key"), "parts"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    lower, upper = F.least("part", "other"), F.greatest("part", "other")
    named = cells.select(F.xxhash64("key", lower, upper).alias("cell"), "mark", "root", "n", "pos", F.when(F.col("part") == lower, 0).otherwise(1).alias("side"), *SKETCH)
    near = materialize(named.repartition("cell").sortWithinPartitions("cell").mapInArrow(_rows_with_partners, "cell long, mark long, root long, n long, pos long, side int"), "partners")
    whole = near.join(picked(near, marked, lambda s: (s.tobytes(),), "shingles binary"), "mark").select(*PLACED, "shingles")
    return whole.repartition("cell").sortWithinPartitions("cell").mapInArrow(_spanning, "a long, b long")


PLACED = ["cell", "mark", "root", "n", "pos", "side"]
SKETCH = ("s0", "s1", "s2", "s3")


def sketch(shingles: np.ndarray) -> tuple[int, ...]:
    """256 parities: each shingle flips the bit that its hash names, so sets differ in as many shingles as bits at least."""
    odd = np.bincount((shingles & U(255)).astype(np.int64), minlength=256) & 1
    return tuple(np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").tolist())


def picked(marks: DataFrame, marked: DataFrame, make, columns: str) -> DataFrame:
    """mark and what make gives for the shingle set of its text, for each mark of marks at least and each once.

    Only texts that a fixed-size filter takes for ones of them are cut into shingles and shuffled.
    """
    place = F.pmod("mark", F.lit(1 << FILTER_BITS)).cast("int")
    wanted = np.zeros(1 << FILTER_BITS, bool)
    wanted[marks.select(place.alias("p")).distinct().toArrow().column("p").to_numpy()] = True
    shared = marked.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    del wanted
    release()
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.binary() if c.endswith("binary") else pa.int64() for c in columns.split(", ")]

    def sets(source):
        bits, done = shared.value, set()
        for batch in source:
            p = batch.column("mark").to_numpy() & ((1 << FILTER_BITS) - 1)
            batch = batch.filter(pa.array((bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, batch.num_rows, 500):
                found = {}
                for mark, text in zip(batch.column("mark").slice(at, 500).to_pylist(), batch.column("text").slice(at, 500).to_pylist()):
                    if mark not in done:
                        done.add(mark)
                        found[mark] = make(shingle_set(text))
                values = list(zip(*found.values())) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), *(pa.array(list(v), t) for v, t in zip(values, types))], ["mark", *names])
        release()

    return marked.mapInArrow(sets, f"mark long, {columns}").dropDuplicates(["mark"])


def checked(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """Those of the pairs (a, b), a written table without repeats, whose shingle sets are similar enough, as a written table."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("mark"))

    def similar(source):
        for batch in source:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(WHOLE * both >= PARTS * (len(p) + len(q) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        release()

    own = materialize(picked(ends, marked, lambda s: (s.tobytes(),), "shingles binary"), "sets")
    x, y = (own.select(F.col("mark").alias(e), F.col("shingles").alias(s)) for e, s in (("a", "x"), ("b", "y")))
    out = materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(similar, "a long, b long"), "similar")
    discard(own)
    return out


def similar_links(marked: DataFrame, known: DataFrame) -> DataFrame:
    """Edges (a, b) that, with the edges known, connect the marks of all texts of similarity 4/5 or more, and no others.

    marked: mark and text. Texts with a mark are taken for equal. Texts of large buckets that the first links have connected aren't compared again. Null texts and texts without words
    have no shingles and no links; an empty table gives none.
    """
    keyed = prefixes(marked).repartition("key").sortWithinPartitions("key", "mark")
    found = materialize(keyed.mapInArrow(_small_and_first, "a long, b long, key long, n long, pos long"), "candidates")
    links = checked(materialize(found.filter("b is not null").select("a", "b").distinct(), "pairs"), marked)
    let_go(marked.sparkSession)
    later = found.filter("b is null").select("key", F.col("a").alias("mark"), "n", "pos")
    if later.isEmpty():
        return links
    roots = components(known.unionByName(links))
    for salt in range(STRAY_ROUNDS):
        more = materialize(stray_pairs(later, roots, salt), "pairs")
        if not more.isEmpty():
            new = checked(more, marked)
            links, roots = links.unionByName(new), components(roots.toDF("a", "b").unionByName(new))
    return links.unionByName(materialize(cross_pairs(later, roots, marked), "similar"))
