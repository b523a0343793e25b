from collections import Counter
from itertools import combinations, permutations

import numpy as np
import pytest

from tests.llm import fixtures
from tidewater.llm.shuffle_shards import communication_matrix, hypergeometric, shuffle_into_shards


def test_matrix_has_exact_margins_and_the_hypergeometric_mean():
    counts = [0, 5, 1000, 37, 211]
    total = np.zeros((5, 7))
    for seed in range(200):
        m = communication_matrix(counts, 7, seed)
        assert m.sum(axis=1).tolist() == counts and np.ptp(m.sum(axis=0)) <= 1 and m.min() >= 0
        total += m
    assert np.allclose(total / 200, np.array(counts)[:, None] / 7, atol=1.5)


def arrangements(counts, sizes):
    """The law of the matrix by listing every arrangement of the rows."""
    part_of = [i for i, n in enumerate(counts) for _ in range(n)]
    shard_of = [j for j, n in enumerate(sizes) for _ in range(n)]
    law = Counter()
    for order in permutations(range(len(shard_of))):
        m = np.zeros((len(counts), len(sizes)), int)
        np.add.at(m, (part_of, [shard_of[k] for k in order]), 1)
        law[tuple(m.ravel().tolist())] += 1
    total = sum(law.values())
    return {k: n / total for k, n in law.items()}


@pytest.mark.parametrize("counts, shards", [([2, 2], 2), ([2, 1, 1], 2), ([3, 3], 3), ([1, 4, 2], 2)])
def test_matrix_has_the_law_of_all_arrangements(counts, shards):
    n = 6000
    seen = Counter(tuple(communication_matrix(counts, shards, seed).ravel().tolist()) for seed in range(n))
    whole, more = divmod(sum(counts), shards)
    law = Counter()
    larger = list(combinations(range(shards), more))
    for chosen in larger:
        for k, p in arrangements(counts, [whole + (j in chosen) for j in range(shards)]).items():
            law[k] += p / len(larger)
    assert set(seen) <= set(law)
    chi = sum((seen[k] - n * p) ** 2 / (n * p) for k, p in law.items())
    assert chi < len(law) - 1 + 5 * (2 * (len(law) - 1)) ** 0.5


def test_draws_agree_with_numpy_and_work_for_any_number():
    rng, other = np.random.default_rng(1), np.random.default_rng(2)
    for good, bad, draws in ((5, 9, 6), (300, 20, 100), (40_000, 60_000, 900)):
        own = np.array([hypergeometric(rng, good, bad, draws) for _ in range(4000)])
        theirs = other.hypergeometric(good, bad, draws, 4000)
        assert abs(own.mean() - theirs.mean()) < 5 * theirs.std() / 4000**0.5 * 2**0.5 and 0.9 < own.std() / theirs.std() < 1.1
    n = 10**12
    own = np.array([hypergeometric(rng, n // 40, n - n // 40, 10**9) for _ in range(500)])
    mean, std = 10**9 / 40, (10**9 / 40 * 39 / 40 * (1 - 10**9 / n)) ** 0.5
    assert abs(own.mean() - mean) < 5 * std / 500**0.5 and 0.85 < own.std() / std < 1.15
    m = communication_matrix([3 * 10**10, 10**10 + 1], 4, 3)
    assert m.sum(axis=1).tolist() == [3 * 10**10, 10**10 + 1] and np.ptp(m.sum(axis=0)) <= 1


def test_shards_are_exact_gapless_and_keep_rows(spark):
    df = fixtures.frame(spark)
    got = shuffle_into_shards(df, 8, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in df.collect())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 8
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    assert all(r.length == "x" and r.start == 5 for r in got)


def test_shuffle_of_few_or_no_rows(spark):
    assert shuffle_into_shards(fixtures.empty(spark), 8, ["doc_id"]).count() == 0
    one = shuffle_into_shards(fixtures.frame(spark, [None, None]), 8, ["doc_id"]).collect()
    assert len({r.shard for r in one}) == 2 and {r.slot for r in one} == {0}


def test_order_is_shuffled(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id").repartition(4)
    got = shuffle_into_shards(ids, 4, ["doc_id"]).orderBy("shard", "slot").collect()
    x = np.array([r.doc_id for r in got], float)
    assert abs(np.corrcoef(x[:-1], x[1:])[0, 1]) < 0.08 and abs(np.corrcoef(x, [r.shard for r in got])[0, 1]) < 0.08


def test_clashing_names_are_kept_or_replaced(spark):
    df = spark.createDataFrame([(i, i, i, i, i, i, i) for i in range(40)], "doc_id long, _cell long, _key long, _part long, _bounds long, _place long, slot long")
    got = shuffle_into_shards(df, 4, ["doc_id"]).collect()
    assert all(r._cell == r._key == r._part == r._bounds == r._place == r.doc_id for r in got)
    assert {(r.shard, r.slot) for r in got} == {(s, k) for s in range(4) for k in range(10)}
