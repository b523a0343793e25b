import random
from itertools import combinations

import numpy as np

from tidewater.llm import similar, simhash
from tidewater.llm.components import components


def word(r):
    return "".join(r.choice("abcdefghijklmnop") for _ in range(6))


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def groups(links, n):
    root = list(range(n))
    for a, b in links:
        x, y = sorted((root[a], root[b]))
        root = [x if v == y else v for v in root]
    return root


def found_groups(spark, texts):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    none = spark.createDataFrame([], "a long, b long")
    links = similar.similar_links(docs.select(F.col("doc_id").alias("mark"), "text"), none)
    pairs = {(r.a, r.b) for r in links.collect()}
    roots = {r.node: r.root for r in components(links).collect()}
    return pairs, [roots.get(i, i) for i in range(len(texts))]


def pairs_near_the_edge():
    """Pairs of texts of a similarity of 0.7 to 0.88."""
    r, texts = random.Random(3), []
    for n in (60, 150, 400):
        for share in range(12, 31):
            words = [word(r) for _ in range(n)]
            cut = n * share // 100
            texts += [" ".join(words), " ".join(words[:-cut] + [word(r) for _ in range(cut // 2)])]
    return texts


def test_pairs_near_the_edge_are_those_of_brute_force(spark):
    texts = pairs_near_the_edge()
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8}
    inside = [jaccard(texts[i], texts[i + 1]) for i in range(0, len(texts), 2)]
    assert sum(0.8 <= s <= 0.85 for s in inside) >= 5 and sum(0.75 <= s < 0.8 for s in inside) >= 5
    pairs, _ = found_groups(spark, texts)
    assert pairs == want


def test_stage_keeps_what_brute_force_keeps(spark):
    texts = pairs_near_the_edge()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == [i for i in range(len(texts)) if i % 2 == 0 or jaccard(texts[i - 1], texts[i]) < 0.8]


def large_group(n=260, seed=4):
    """Texts that share most of one passage; many pairs are just above or just below 0.8."""
    r = random.Random(seed)
    base, texts = [word(r) for _ in range(120)], []
    for _ in range(n):
        words = list(base)
        for at in r.sample(range(len(words)), r.choice([1, 2, 3])):
            words[at] = word(r)
        texts.append(" ".join(words))
    return texts


def test_large_groups_are_linked_as_by_brute_force(spark, monkeypatch):
    texts = large_group()
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8}
    for small, cell, seen in ((16, 2048, 4), (2, 20, 4), (2, 20, 1 << 20), (16, 64, 1 << 20)):
        for name, value in (("SMALL", small), ("CELL", cell), ("SEEN", seen)):
            monkeypatch.setattr(similar, name, value)
        pairs, roots = found_groups(spark, texts)
        assert pairs <= want and roots == groups(want, len(texts))


def test_large_buckets_give_fewer_links_than_texts(spark, monkeypatch):
    texts = large_group()
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8}
    docs = spark.createDataFrame(list(enumerate(texts)), "mark long, text string").repartition(4)
    rows = spark.createDataFrame([(1, i, len(shingles(t)), 0) for i, t in enumerate(texts)], "key long, mark long, n long, pos long")
    none = spark.createDataFrame([], "node long, root long")
    for cell, many, cells in ((2048, 1 << 20, 1), (2048, 1 << 14, 3), (130, 1 << 20, 3)):  # in one cell, or two parts and three cells
        monkeypatch.setattr(similar, "CELL", cell)
        monkeypatch.setattr(similar, "CELL_SHINGLES", many)
        pairs = [(r.a, r.b) for r in similar.cross_pairs(rows, none, docs).collect()]
        assert set(pairs) <= want and groups(pairs, len(texts)) == groups(want, len(texts))
        assert len(pairs) < cells * len(texts) < len(want)


def test_links_of_odd_texts(spark):
    texts = ["", " ", "one", "one", "One", "a b c d e", "a b c d e f", "a b c d e", None, "q " * 500, "q " * 600]
    pairs, _ = found_groups(spark, texts)
    assert pairs == {(2, 3), (2, 4), (3, 4), (5, 7), (9, 10)}
    assert found_groups(spark, [""])[0] == set()


def test_prefix_puts_common_shingles_last():
    import numpy as np

    s = np.arange(10, 20).astype(np.uint64)
    common = np.array([10, 11, 15], np.uint64)
    assert similar.prefix(s, common, np.array([2, 0, 1])).tolist() == [12, 13, 14]
    assert similar.prefix(s, np.zeros(0, np.uint64), np.zeros(0, np.int64)).tolist() == [10, 11, 12]
    assert similar.prefix(s[:1], common, np.array([2, 0, 1])).tolist() == [10]


def test_stage_links_large_groups_whatever_a_bucket_holds(spark, monkeypatch):
    from tests.llm.test_simhash import brute_fingerprint

    texts = large_group(120)
    prints = [brute_fingerprint(t) for t in texts]
    want = groups([(i, j) for i, j in combinations(range(len(texts)), 2) if jaccard(texts[i], texts[j]) >= 0.8 or (prints[i] ^ prints[j]).bit_count() <= 2], len(texts))
    monkeypatch.setattr(simhash, "HOT", 16)
    monkeypatch.setattr(similar, "CELL", 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want))


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(1)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, 400, dtype=np.uint64)
        a, b = (np.unique(pool[r.random(400) < r.uniform(0.02, 0.9)]) for _ in range(2))
        bits = sum(((x ^ y) & ((1 << 64) - 1)).bit_count() for x, y in zip(similar.sketch(a), similar.sketch(b)))
        assert bits <= len(np.setxor1d(a, b))
