"""Uniform shuffle into shards of exact sizes (operator 6).

The matrix of counts that each part of the input sends to each shard is drawn exactly (multivariate hypergeometric,
part after part from what the shards have left). Each part then puts its rows in a random order and deals them out by
its row of the matrix, and each shard puts what it gets in a random order again: every arrangement is as likely as
any other, and shard sizes differ by one row at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import free_name, group_buckets, materialize, ranked

#: Parts of the input are folded into so many, so that the matrix has a bounded size.
MOST_PARTS = 4096


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows drawn without putting back are among the `good` ones, exactly and for any numbers.

    The probabilities follow from each other: up and down from the most likely count they are products of ratios. Counts
    beyond 12 standard deviations and 40 more (less than 1e-30 of the law) are left out.
    """
    low, high, total = max(0, draws - bad), min(draws, good), good + bad
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    deviation = (draws * good / total * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(12 * deviation) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)  # steps from k to k + 1
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weights = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.exp(weights - weights.max())
    ends = np.cumsum(weights)
    return int(k[0]) + int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Rows that each part sends to each shard: rows sum to counts, columns to sizes that differ by one at most."""
    rng, total = np.random.default_rng(seed), sum(counts)
    sizes = [total // n_shards + int(i < total % n_shards) for i in range(n_shards)]
    sizes = [sizes[i] for i in rng.permutation(n_shards).tolist()]
    out = np.zeros((len(counts), n_shards), np.int64)
    for i, n in enumerate(counts):
        rest = sum(sizes)
        for j in range(n_shards):  # what shard j gets of the part's rows that the shards before it left
            rest -= sizes[j]
            out[i, j] = taken = hypergeometric(rng, sizes[j], rest, n)
            n -= taken
            sizes[j] -= taken
    return out


def shuffle_into_shards(df: DataFrame, n_shards: int, key: list[str], seed: int = 42) -> DataFrame:
    """df with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), in uniformly random places.

    key: columns from which, with the seed and the part, the random order of a row derives; rows that agree in all
    of them are interchangeable. Nulls and repeated rows count like any others. An empty table stays empty. Columns of
    df named shard and slot are replaced; all others are kept. Only counts of parts (at most 4,096) come to the
    driver; parts and shards are dealt out by windows over bounded groups.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    cell_of, key_of, place_of = (free_name(df.columns, n) for n in ("_cell", "_key", "_place"))
    random_key = F.xxhash64(F.lit(seed), F.spark_partition_id(), F.monotonically_increasing_id(), *key)
    held = materialize(df.select("*", F.pmod(F.spark_partition_id(), F.lit(MOST_PARTS)).alias(cell_of), random_key.alias(key_of)), "shards")
    counts = sorted((r[0], r[1]) for r in held.groupBy(cell_of).count().collect())
    if not counts:
        return df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    matrix = communication_matrix([n for _, n in counts], n_shards, seed)
    rows = [(c, np.cumsum(row).tolist()) for (c, _), row in zip(counts, matrix)]
    bounds = spark.createDataFrame(rows, "_c int, _bounds array<long>")
    total = sum(n for _, n in counts)
    most = group_buckets(max(n for _, n in counts))
    dealt = ranked(held, [cell_of], [F.col(key_of)], F.pmod(F.shiftright(key_of, 20), F.lit(most)), place_of)
    shard = F.size(F.filter(bounds["_bounds"], lambda b: b <= F.col(place_of)))
    both = dealt.join(F.broadcast(bounds), dealt[cell_of] == bounds["_c"])  # at most MOST_PARTS rows
    dealt = materialize(both.select(*[dealt[c] for c in df.columns], F.xxhash64(F.lit(seed + 1), key_of, place_of).alias(key_of), shard.alias("shard")), "dealt")
    parts = max(8, group_buckets(total // n_shards))
    return ranked(dealt, ["shard"], [F.col(key_of)], F.pmod(F.shiftright(key_of, 20), F.lit(parts)), "slot").drop(key_of)
