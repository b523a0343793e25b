"""Nearest neighbours by multi-index hashing of learned codes (operator 7).

Vectors become 256-bit codes: signs after rotations that are learned to lose little (iterative quantisation). Codes are
split into 16 substrings of 16 bits, each of which is indexed. Substrings get probe distances that sum to less than the
radius allows (pigeonhole: the distances plus one sum to the radius plus one), so probing each index retrieves every
code within the radius; these are reranked by the inner product of the original vectors.

The radius is learned on some queries and all rows, so it shrinks as the table grows, and a query's own radius shrinks as
better neighbours are found for it. A query that finds too few is repeated over all codes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import bounded_sample, discard, materialize, release

BITS, PARTS = 256, 16
#: Queries that are sent to all tasks at a time (a fixed size), and candidates that a task indexes at a time.
QUERY_BLOCK, CANDIDATE_BLOCK = 16384, 16384
#: Pairs of queries and rows whose codes are compared at a time.
AT_ONCE = 1 << 22


@dataclass
class Coder:
    """projection: a column for each bit. norm: the largest norm, to which candidates are lengthened by one more
    coordinate, so that the largest inner product is the smallest angle; queries have 0 there. levels: rising scores,
    and for each the radius that takes in candidates of that score or a better one."""

    projection: np.ndarray
    norm: float
    radius: int = BITS
    levels: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0, np.int64))

    def codes(self, x: np.ndarray, query: bool) -> np.ndarray:
        return np.packbits(lengthened(x, self.norm, query) @ self.projection > 0, axis=1, bitorder="little")

    def radius_for(self, score: float) -> int:
        """The radius in which better candidates than one of this score are looked for."""
        at = int(np.searchsorted(self.levels[0], score, side="right")) - 1
        return self.radius if at < 0 else min(self.radius, int(self.levels[1][at]))


def lengthened(x: np.ndarray, norm: float, query: bool) -> np.ndarray:
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def learn_rotation(x: np.ndarray, bits: int, seed: int, rounds: int = 30) -> np.ndarray:
    """Principal directions turned so that the signs of the result are close to the result itself."""
    r = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))
    vectors = vectors[:, np.argsort(-values)][:, :bits]
    v, turn = x @ vectors, np.linalg.qr(r.standard_normal((vectors.shape[1], vectors.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (u @ w).T
    return vectors @ turn


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each code of a from each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(a.view(np.uint64).T, b.view(np.uint64).T):
        out += np.bitwise_count(x[:, None] ^ y[None, :])
    return out


def coder_of(sample: np.ndarray, norm: float, seed: int = 42) -> Coder:
    x = lengthened(sample, norm, False)
    parts, left = [], BITS
    while left:
        parts.append(learn_rotation(x, min(left, x.shape[1]), seed + left))
        left -= parts[-1].shape[1]
    return Coder(np.column_stack(parts), norm)


def with_radius(coder: Coder, scores: np.ndarray, bits: np.ndarray, share: float) -> Coder:
    """coder with radii that take in a share of the true neighbours given by their scores and code distances."""
    if not len(scores):
        return coder
    order = np.argsort(scores)
    scores, bits = scores[order], bits[order]
    starts = np.arange(0, max(1, len(scores) - 200), max(1, len(scores) // 64))
    radii = [int(np.quantile(bits[at:], share, method="higher")) for at in starts.tolist()]
    return Coder(coder.projection, coder.norm, radii[0], (scores[starts], np.maximum.accumulate(np.array(radii)[::-1])[::-1]))


def probe_distances(radius: int) -> np.ndarray:
    """For each substring the distance to which its index is probed: with one more each, they sum to radius + 1 at least."""
    each, more = divmod(radius + 1, PARTS)
    return np.array([each - 1 + (p < more) for p in range(PARTS)])


#: All differences of a substring, those of fewer bits first, and how many have up to so many bits.
MASKS = np.arange(1 << 16, dtype=np.uint32)[np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint32)), kind="stable")].astype(np.uint16)
UP_TO = np.cumsum(np.bincount(np.bitwise_count(MASKS), minlength=17))


class Index:
    """Tables of a block of codes, one for each substring: rows by the substring's value.

    A probe looks up every value within its distance. There are as many values as the distance has masks; where they
    outnumber the rows of the block, which happens at wide radii, all rows' values are compared instead, which gives the
    same rows. looked counts the rows that probes have given.
    """

    def __init__(self, codes: np.ndarray):
        self.words = np.ascontiguousarray(codes.view(np.uint64).T)
        self.parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.order = np.argsort(self.parts, axis=1, kind="stable")
        self.sorted = np.take_along_axis(self.parts, self.order, axis=1)
        self.looked = 0

    def probe(self, part: int, value: int, most: int) -> np.ndarray:
        """Rows whose substring differs from value in at most so many bits."""
        if UP_TO[most] > self.parts.shape[1] // 4:
            return np.flatnonzero(np.bitwise_count(self.parts[part] ^ value) <= most)
        wanted = MASKS[: UP_TO[most]] ^ value
        low, high = (np.searchsorted(self.sorted[part], wanted, side=s) for s in ("left", "right"))
        hit = high > low
        low, size = low[hit], (high - low)[hit]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.order[part][np.repeat(low, size) + within]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within the radius, ascending."""
        n = self.parts.shape[1]
        marked = np.zeros(n, bool)
        for part, (value, most) in enumerate(zip(code.view(np.uint16), probe_distances(radius).tolist())):
            if most >= 0:
                marked[self.probe(part, value, most)] = True
        rows = np.flatnonzero(marked)
        self.looked += len(rows)
        d = np.zeros(len(rows), np.uint16)
        for word, value in zip(self.words, code.view(np.uint64)):
            d += np.bitwise_count(word[rows] ^ value)
        return rows[d <= radius]


def inner_products(c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the order of the components, wherever its row stands."""
    out = np.zeros(len(c))
    for j in range(len(q)):
        out += c[:, j] * q[j]
    return out


class Best:
    """The k best candidates of each query so far: larger score first, ties to the smaller id, each id once with its best vector."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]

    def least(self, i: int) -> float:
        """The score that another candidate has to reach."""
        scores = self.found[i][1]
        return scores[-1] if len(scores) == self.k else -np.inf

    def offer(self, i: int, ids: np.ndarray, vectors: np.ndarray, single: bool) -> None:
        """single: no id stands twice among the ids."""
        q = self.queries[i]
        scores = np.where(ids == self.ids[i], -np.inf, vectors @ q)
        edge = self.least(i)
        if single and len(scores) > self.k:
            edge = max(edge, np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
        keep = np.flatnonzero(scores >= edge - 1e-9 * max(1.0, abs(edge))) if np.isfinite(edge) else np.flatnonzero(np.isfinite(scores))
        if not len(keep):
            return
        all_ids = np.concatenate([self.found[i][0], ids[keep]])
        all_scores = np.concatenate([self.found[i][1], inner_products(vectors[keep], q)])
        order = np.lexsort((all_ids, -all_scores))
        order = order[np.sort(np.unique(all_ids[order], return_index=True)[1])][: self.k]
        self.found[i] = all_ids[order], all_scores[order]

    def table(self) -> pa.Table:
        sizes = [len(f[0]) for f in self.found]
        columns = [np.repeat(self.ids, sizes), np.concatenate([np.zeros(0, np.int64), *(f[0] for f in self.found)]), np.concatenate([np.zeros(0), *(f[1] for f in self.found)])]
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def search(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, coder: Coder, k: int, size: int, everything: bool = False) -> DataFrame:
    """query_id, vec_id, score: the k best that each task finds for each query within its radius, or among all its rows."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, queries, coder))

    def run(source):
        ids, queries, coder = shared.value
        codes, best, held = coder.codes(queries, True), Best(ids, queries, k), []

        def look():
            c_ids, c = (np.concatenate(x) for x in zip(*held))
            single = len(np.unique(c_ids)) == len(c_ids)
            index = None if everything else Index(coder.codes(c, False))
            for i in range(len(ids)):
                if everything:
                    best.offer(i, c_ids, c, single)
                else:
                    rows = index.within(codes[i], coder.radius_for(best.least(i)))
                    if len(rows):
                        best.offer(i, c_ids[rows], c[rows], single)

        for batch in source:
            if batch.num_rows:
                held.append(_matrix(batch, size))
                if sum(len(h[0]) for h in held) >= CANDIDATE_BLOCK:
                    look()
                    held = []
        if held:
            look()
        yield from best.table().to_batches(max_chunksize=1 << 16)
        release()

    return candidates.select("vec_id", "v").mapInArrow(run, "query_id long, vec_id long, score double")


def true_neighbours(candidates: DataFrame, ids: np.ndarray, queries: np.ndarray, coder: Coder, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and code distances of the k nearest of some queries among all candidates, by inner products alone."""
    shared = candidates.sparkSession.sparkContext.broadcast((ids, queries, coder))

    def run(source):
        ids, queries, coder = shared.value
        codes, kept = coder.codes(queries, True), None
        for batch in source:
            c_ids, c = _matrix(batch, size)
            for at in range(0, len(c_ids), max(1, AT_ONCE // max(1, len(ids)))):
                own, x = c_ids[at : at + AT_ONCE // len(ids)], c[at : at + AT_ONCE // len(ids)]
                scores = np.where(own[None, :] == ids[:, None], -np.inf, queries @ x.T)
                bits = distances(codes, coder.codes(x, False))
                new = (scores, bits) if kept is None else (np.hstack([kept[0], scores]), np.hstack([kept[1], bits]))
                top = np.argsort(-new[0], axis=1, kind="stable")[:, :k]
                kept = tuple(np.take_along_axis(x, top, axis=1) for x in new)
        if kept is not None:
            of = np.repeat(np.arange(len(ids)), kept[0].shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(kept[0].ravel()), pa.array(kept[1].ravel().astype(np.int64))], ["query", "score", "bits"])
        release()

    found = candidates.select("vec_id", "v").mapInArrow(run, "query long, score double, bits long").filter(F.col("score") > float("-inf"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "bits")
    rows = found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).toArrow()  # k rows for each of the few queries
    return rows.column("score").to_numpy(), rows.column("bits").to_numpy()


def _matrix(t, size: int) -> tuple[np.ndarray, np.ndarray]:
    flat = t.column("v")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return t.column("vec_id").to_numpy(), flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and v of the rows that take part: neither null nor zero, no null or non-finite component."""
    v = F.col(vector_column)
    odd = F.exists(v, lambda x: F.coalesce(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    whole = v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_column).isNotNull() & whole).select(F.col(id_column).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", sample_rows: int = 4000, sample_queries: int = 256, share: float = 0.985, seed: int = 42) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products found for each query row.

    is_query: a condition on vec_id. Candidates are all usable rows but those with the query's id; a query has all of
    them if there are k or fewer. Scores are sums in double precision in the order of the components, so equal vectors
    tie exactly, and ties go to the smaller vec_id. Repeated vec_ids: an id is a candidate once, with its nearest
    vector; a query with several vectors is asked with the smallest of them. Vectors that are null or zero or hold
    null or non-finite components take no part, nor do vectors of another length than the most frequent, for which
    the inner product isn't defined. An empty table gives none.

    The rotations are learned on at most sample_rows rows; the radius, which takes in a `share` of the true neighbours, on
    sample_queries queries against all rows. Every row is indexed. Queries go to all tasks in blocks of a fixed size;
    vectors are never shuffled, only the k best that each task finds for each query.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column).withColumn("size", F.size("v"))
    sizes = sorted(rows.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").take(1))
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    size = sizes[0][0]
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    held = materialize(rows.filter(F.col("size") == size).select("vec_id", "v", is_query.alias("is_query"), norm2.alias("norm2")), "vectors")
    norm = held.agg(F.sqrt(F.max("norm2"))).first()[0]
    sample = bounded_sample(held.select("vec_id", "v"), [F.col("vec_id"), F.col("v")], sample_rows, seed).toArrow().sort_by("vec_id")
    coder = coder_of(_matrix(sample, size)[1], float(norm), seed)
    queries = materialize(held.filter("is_query").groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_queries = queries.count()
    some = bounded_sample(queries, [F.col("vec_id")], sample_queries, seed).toArrow().sort_by("vec_id")
    if len(some):
        coder = with_radius(coder, *true_neighbours(held, *_matrix(some, size), coder, k, size), share)

    def ranks(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each task
        return one.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def in_blocks(asked: DataFrame, n: int, everything: bool) -> DataFrame:
        parts, out = max(1, -(-n // QUERY_BLOCK)), None
        for block in range(parts):
            mine = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == block).select("vec_id", "v").toArrow().sort_by("vec_id")
            found = ranks(search(held, *_matrix(mine, size), coder, k, size, everything))
            found = materialize(found, "near") if parts > 1 or not everything else found
            out = found if out is None else out.unionByName(found)
        return out

    first = in_blocks(queries, n_queries, False)
    got = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("got"))
    short = materialize(queries.join(got, "vec_id", "left").filter(F.coalesce("got", F.lit(0)) < k).select("vec_id", "v"), "short")
    n_short = short.count()
    if not n_short:
        discard(queries, short)
        return first
    rest = in_blocks(short, n_short, True)
    return first.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)
