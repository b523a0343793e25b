"""Scores by cross-entropy difference of two n-gram models (operator 8).

Tokens are code points. A target model is counted on the documents that a label marks, a background model on all
documents; both have the same order, smoothing and vocabulary. A document's score is its mean loss per token under
the target model less that under the background model: low scores are like the target. Both models score the rows
that they were counted on, too; a target condition that leaves rows out holds them out of the target model.

An n-gram is its last symbol and its context, the ORDER - 1 symbols before it in 21 bits each. Texts are written once, in
packs of consecutive rows. A pack asks once for each n-gram that it holds, and a join gives it exactly those losses, so
what a task holds depends on the pack and not on the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from tidewater.llm.common import discard, materialize, release, tune

ORDER = 4
#: Weight of the lower order in each order's estimate, in tokens.
WEIGHT = 4.0
#: Code points that are turned into n-grams at a time, and so many at most that a pack of several texts holds.
BLOCK, PACK = 1 << 21, 1 << 25
#: Bits of a symbol: a code point plus 1; symbol 0 stands before a text's start.
SYMBOL = 21

U = np.uint64


class Ngrams:
    """The distinct n-grams of some symbols (context and symbol), and the number of the one at each place that counts, or how many places each has."""

    def __init__(self, codes: np.ndarray, own: np.ndarray, wanted: np.ndarray | None = None):
        """codes: symbols; own: the places that count, ORDER - 1 symbols from the start of the text at least.

        wanted: whether each of these places is also counted apart; then there are counts (all, some) and no numbers.
        """
        there = np.zeros(1 << SYMBOL, bool)
        there[codes] = True
        symbols = np.flatnonzero(there)
        bits = max(1, int(len(symbols) - 1).bit_length())
        if bits * ORDER <= 64:  # numbers of the symbols in this block fit in one word
            short = np.zeros(1 << SYMBOL, np.uint64)
            short[symbols] = np.arange(len(symbols), dtype=U)
            local = short[codes]
            keys = local.copy()
            for back in range(1, ORDER):
                keys[back:] |= local[:-back] << U(bits * back)
            if wanted is None:
                found, self.number = np.unique(keys[own], return_inverse=True)
            else:
                keys = keys[own]
                found, self.all = np.unique(keys, return_counts=True)
                apart, n = np.unique(keys[wanted], return_counts=True)
                self.some = np.zeros(len(found), np.int64)
                self.some[np.searchsorted(found, apart)] = n
            part = [symbols[(found >> U(bits * back) & U((1 << bits) - 1)).astype(np.int64)] for back in range(ORDER)]
            self.symbol = part[0]
            self.context = sum(x << (SYMBOL * back) for back, x in enumerate(part[1:]))
        else:
            wide = codes.astype(np.int64)
            context = np.zeros(len(wide), np.int64)
            for back in range(1, ORDER):
                context[back:] |= wide[:-back] << (SYMBOL * (back - 1))
            contexts, number = np.unique(context[own], return_inverse=True)
            found, self.number = np.unique(number << SYMBOL | wide[own], return_inverse=True)
            self.symbol, self.context = found & ((1 << SYMBOL) - 1), contexts[found >> SYMBOL]
            if wanted is not None:
                self.all, self.some = (np.bincount(x, minlength=len(found)) for x in (self.number, self.number[wanted]))


def blocks(texts: list[str | None], marks: list | None = None):
    """Blocks of about BLOCK code points: their n-grams, and the text and the length of each run of places in them.

    A longer text is cut; each stretch comes with the symbols before it, so that no n-gram is lost. marks: whether the
    n-grams of each text are also counted apart.
    """
    lead = ORDER - 1
    parts, rows, size = [], [], 0

    def made():
        codes = np.concatenate(parts)
        own = np.ones(len(codes), bool)
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        own[(starts[:, None] + np.arange(lead)).ravel()] = False
        of, sizes = [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)
        return Ngrams(codes, np.flatnonzero(own), None if marks is None else np.repeat(np.array([marks[i] for i in of], bool), sizes)), of, sizes

    for i, t in enumerate(texts):
        c = np.concatenate([np.zeros(lead, np.uint32), np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) + np.uint32(1)])
        for at in range(0, max(1, len(c) - lead), BLOCK):
            parts.append(c[at : at + BLOCK + lead])
            rows.append((i, len(parts[-1]) - lead))
            size += len(parts[-1])
            if size >= BLOCK:
                yield made()
                parts, rows, size = [], [], 0
    if parts:
        yield made()


def merged(found: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """context, symbol and sums of the other columns, each n-gram once."""
    context, symbol, *sums = (np.concatenate(x) for x in zip(*found))
    contexts, number = np.unique(context, return_inverse=True)
    keys, at = np.unique(number << SYMBOL | symbol, return_inverse=True)
    return (contexts[keys >> SYMBOL], keys & ((1 << SYMBOL) - 1), *(np.bincount(at, x, len(keys)).astype(np.int64) for x in sums))


def asked(rows: DataFrame) -> DataFrame:
    """pack, context, symbol, c_t, c_b: occurrences of every n-gram of each pack in its target documents and in all.

    rows: pack, text and target, packs in runs. A pack that two tasks read has rows from both.
    """
    names = ["pack", "context", "symbol", "c_t", "c_b"]

    def sums(pack, held):
        columns = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), pack)), *map(pa.array, columns)], names)

    def run(source):
        now, held = None, []
        for batch in source:
            packs = batch.column("pack").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(packs)) + 1).tolist(), len(packs)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and packs[a] != now:
                    yield sums(now, held)
                    held = []
                now, part = packs[a], batch.slice(a, b - a)
                for grams, _, _ in blocks(part.column("text").to_pylist(), part.column("target").to_pylist()):
                    held.append((grams.context, grams.symbol, grams.some, grams.all))
                held = [merged(held)] if len(held) > 8 else held
        if held:
            yield sums(now, held)
        release()

    return rows.select("pack", "text", "target").mapInArrow(run, "pack long, context long, symbol long, c_t long, c_b long")


def in_packs(rows: DataFrame, most: int | None = None) -> DataFrame:
    """rows (doc_id, text, target) with pack: rows that follow each other in a task, of at most so many code points together, or one row.

    A row counts 16 code points more than its text has, so that empty texts don't fill a pack without end. Packs follow
    from the order in which a task meets its rows: write the result, and read packs from there.
    """
    most = most or PACK

    def run(source):
        pack, filled = TaskContext.get().partitionId() << 33, 0
        for batch in source:
            packs = []
            for n in pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist():
                if filled and filled + n + 16 > most:
                    pack, filled = pack + 1, 0
                filled += n + 16
                packs.append(pack)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int64())], [*batch.schema.names, "pack"])
        release()

    some = rows.select("doc_id", "text", "target")
    return some.mapInArrow(run, StructType([*some.schema.fields, StructField("pack", LongType())]))


def losses(counts: DataFrame) -> DataFrame:
    """context, symbol, loss_t, loss_b of every n-gram: each order's estimate leans on the next lower one's, down to the uniform.

    counts: context, symbol, c_t and c_b of every n-gram of the highest order, each once; a written table, as each order reads it. An empty one gives none.
    """
    def short(order: int) -> Column:
        return F.col("context").bitwiseAND(F.lit((1 << (SYMBOL * (order - 1))) - 1))

    def level(order: int) -> DataFrame:
        return counts.groupBy(short(order).alias("context"), "symbol").agg(F.sum("c_t").alias("c_t"), F.sum("c_b").alias("c_b"))

    one = level(1)
    size, all_t, all_b = one.agg(F.count(F.lit(1)), F.sum("c_t"), F.sum("c_b")).first()
    uniform = 1.0 / (size + 1)
    lower = one.select("context", "symbol", *[((F.col(f"c_{m}") + WEIGHT * uniform) / ((n or 0) + WEIGHT)).alias(f"p_{m}") for m, n in (("t", all_t), ("b", all_b))])
    for order in range(2, ORDER + 1):
        around = Window.partitionBy("context")  # at most as many rows as there are code points
        here = level(order).select("context", "symbol", "c_t", "c_b", short(order - 1).alias("_short"), *[F.sum(f"c_{m}").over(around).alias(f"n_{m}") for m in "tb"])
        below = lower.select(F.col("context").alias("_short"), "symbol", F.col("p_t").alias("q_t"), F.col("p_b").alias("q_b"))
        joined = here.join(below, ["_short", "symbol"])
        lower = joined.select("context", "symbol", *[((F.col(f"c_{m}") + WEIGHT * F.col(f"q_{m}")) / (F.col(f"n_{m}") + WEIGHT)).alias(f"p_{m}") for m in "tb"])
    return lower.select("context", "symbol", (-F.log("p_t")).alias("loss_t"), (-F.log("p_b")).alias("loss_b"))


def score_pack(rows: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id, n, s_t, s_b of a pack's texts; answers: the losses of all of its n-grams."""
    context, symbol, *loss = (answers.column(c).to_numpy() for c in ("context", "symbol", "loss_t", "loss_b"))
    contexts, number = np.unique(context, return_inverse=True)
    keys, first = np.unique(number << SYMBOL | symbol, return_index=True)
    loss = [x[first] for x in loss]
    n, sums = np.zeros(len(rows), np.int64), [np.zeros(len(rows)) for _ in loss]
    for grams, of, sizes in blocks(rows.column("text").to_pylist()):
        place = np.searchsorted(keys, np.searchsorted(contexts, grams.context) << SYMBOL | grams.symbol)
        at = np.repeat(np.array(of), sizes)
        n += np.bincount(at, minlength=len(rows))
        for total, x in zip(sums, loss):
            total += np.bincount(at, x[place][grams.number], len(rows))
    release()
    return pa.table([rows.column("doc_id").cast(pa.int64()), pa.array(n), *map(pa.array, sums)], ["doc_id", "n", "s_t", "s_b"])


def score_documents(docs: DataFrame, target: Column) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background and score (their difference) of every whole text.

    target: a condition on columns of docs; null is false. Counts come from all documents, whole, by a shuffle of
    n-grams with sums taken in each pack first; every n-gram has its own loss at every size of the corpus, and every
    code point is a symbol of its own. Null and empty texts have no tokens and null losses and score. Without target
    documents the target model is uniform. Repeated rows count each, and repeated or null ids have a row each; other
    columns are ignored; an empty table gives none.
    """
    tune(docs.sparkSession)
    packed = materialize(in_packs(docs.select("doc_id", "text", F.coalesce(target, F.lit(False)).alias("target"))), "rows")
    held = materialize(asked(packed), "ngrams")
    totals = materialize(held.groupBy("context", "symbol").agg(F.sum("c_t").alias("c_t"), F.sum("c_b").alias("c_b")), "totals")
    found = materialize(losses(totals), "losses")
    discard(totals)
    answers = held.select("pack", "context", "symbol").join(found, ["context", "symbol"])
    texts = packed.select("pack", "doc_id", "text").groupBy("pack")
    sums = texts.cogroup(answers.groupBy("pack")).applyInArrow(score_pack, "doc_id long, n long, s_t double, s_b double")
    mean = lambda c: F.when(F.col("n") > 0, c / F.col("n"))
    return sums.select("doc_id", F.col("n").alias("n_tokens"), mean(F.col("s_t")).alias("loss_target"), mean(F.col("s_b")).alias("loss_background"), mean(F.col("s_t") - F.col("s_b")).alias("score"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with is_target: whether a label has quality 1. Repeated labels count once; documents without one are not.

    Labels grow with the documents, so they are never broadcast: both sides are dealt out by doc_id at every size.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct().withColumn("is_target", F.lit(True)).hint("merge")
    return docs.select("doc_id", "text").join(good, "doc_id", "left")
