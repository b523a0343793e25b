import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm import fixtures
from tidewater.llm import lm_score, multi_index

VECTORS = "vec_id long, embedding array<float>, label int, score string, rank string, v string"


def vectors(spark, n=900, d=32, seed=1, scale=False):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) + 0.5 * r.standard_normal((8, d))[r.integers(0, 8, n)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= r.uniform(0.3, 3, n)[:, None]
    x = x.astype(np.float32)
    x[n // 2] = x[n // 2 + 1]
    rows = [(i, [float(v) for v in x[i]], 0, "a", "b", "c") for i in range(n)]
    odd = [(20 * n, None), (20 * n + 20, [0.0] * d), (20 * n + 40, [float("nan")] * d), (20 * n + 60, [None] + [1.0] * (d - 1)), (20 * n + 80, [float("inf")] * d), (20 * n + 100, [1.0]), (20 * n + 120, [])]
    return x.astype(float), spark.createDataFrame(rows + [(i, v, 0, "a", "b", "c") for i, v in odd], VECTORS)


def sum_in_order(a, b):
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist()):
        total += x * y
    return total


def brute(x, k):
    out = {}
    for q in range(0, len(x), 20):
        s = [float(np.dot(x[q], x[j])) for j in range(len(x))]
        out[q] = sorted(((-s[j], j) for j in range(len(x)) if j != q))[:k]
    return out


def test_recall_scores_and_order(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CANDIDATE_BLOCK", 256)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 16)
    for scale in (False, True):
        x, frame = vectors(spark, scale=scale)
        got = multi_index.nearest(frame, F.col("vec_id") % 20 == 0, 20, sample_rows=400).collect()
        want, by = brute(x, 20), {}
        for r in got:
            by.setdefault(r.query_id, []).append(r)
        assert set(by) == set(want)
        hit = 0
        for q, rows in by.items():
            rows.sort(key=lambda r: r["rank"])
            assert [r["rank"] for r in rows] == list(range(1, 21))
            assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
            assert all(r.score == sum_in_order(x[q], x[r.vec_id]) for r in rows)
            hit += len({r.vec_id for r in rows} & {j for _, j in want[q]})
        assert hit / (20 * len(want)) >= 0.9


def test_few_candidates_are_all_returned(spark):
    _, frame = vectors(spark, n=8)
    got = multi_index.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(r.vec_id for r in got) == [1, 2, 3, 4, 5, 6, 7] and {r.query_id for r in got} == {0}
    assert multi_index.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_probing_finds_every_code_within_the_radius():
    r = np.random.default_rng(3)
    codes = r.integers(0, 256, (500, multi_index.BITS // 8)).astype(np.uint8)
    codes[100:200] = codes[0] ^ (1 << r.integers(0, 8, (100, 32))).astype(np.uint8) * (r.random((100, 32)) < 0.4)
    index = multi_index.Index(codes)
    for radius in (0, 3, 15, 16, 40, 110, 128, 256):
        assert (multi_index.probe_distances(radius) + 1).sum() == radius + 1
        for q in codes[:30]:
            d = np.array([sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(q, c)) for c in codes])
            assert index.within(q, radius).tolist() == np.flatnonzero(d <= radius).tolist()


def test_probes_of_small_radii_look_up_few_rows():
    r = np.random.default_rng(5)
    centres = r.integers(0, 256, (60, multi_index.BITS // 8)).astype(np.uint8)
    flips = np.packbits(r.random((6000, multi_index.BITS)) < 0.03, axis=1)
    codes = centres[np.arange(6000) % 60] ^ flips
    index = multi_index.Index(codes)
    for q in codes[:40]:
        d = np.bitwise_count(codes.view(np.uint64) ^ q.view(np.uint64)).sum(1)
        assert index.within(q, 31).tolist() == np.flatnonzero(d <= 31).tolist() and (d <= 31).sum() > 90
    assert index.looked < 0.1 * 40 * 6000


def test_packs_hold_a_bounded_number_of_code_points(spark):
    texts = [""] * 300 + [None] + ["ab " * k for k in range(1, 150)] + ["x" * 5000]  # in order of length
    df = spark.createDataFrame([(i, t, i % 3 == 0) for i, t in enumerate(texts)], "doc_id long, text string, target boolean").coalesce(2)
    got = lm_score.in_packs(df, 1000).collect()
    assert len(got) == len(texts)
    sizes = {}
    for r in got:
        n, rows = sizes.get(r.pack, (0, 0))
        sizes[r.pack] = n + len(r.text or "") + 16, rows + 1
    assert all(n <= 1000 or rows == 1 for n, rows in sizes.values()) and 5 < len(sizes) < 120


def test_copies_tie_exactly_and_repeated_ids_count_once(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 2)
    r = np.random.default_rng(5)
    x = r.standard_normal((200, 64)).astype(np.float32)
    x[13:200:9] = x[3]  # 21 copies, in different blocks
    rows = [(i, [float(v) for v in x[i]]) for i in range(200)]
    rows += rows[:60] * 2 + [(60, [float(v) for v in x[61]]), (None, rows[0][1])]
    got = multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3), F.col("vec_id") % 20 == 0, 20).collect()
    by = {}
    for row in sorted(got, key=lambda g: (g.query_id, g["rank"])):
        by.setdefault(row.query_id, []).append(row)
    assert set(by) == set(range(0, 200, 20)) and all(len({g.vec_id for g in found}) == 20 for found in by.values())
    copies = [3, *range(13, 200, 9)]
    for q, found in by.items():
        shown = [g.vec_id for g in found if g.vec_id in copies]
        assert len({g.score for g in found if g.vec_id in copies}) <= 1 and shown == [c for c in copies if c != q][: len(shown)]


def test_radius_shrinks_with_the_score():
    coder = multi_index.with_radius(multi_index.Coder(np.zeros((2, 256)), 1.0), np.linspace(0, 1, 2000), np.linspace(120, 10, 2000).astype(int), 0.985)
    radii = [coder.radius_for(s) for s in (-1, 0, 0.3, 0.6, 0.9, 2)]
    assert radii == sorted(radii, reverse=True) and radii[0] == coder.radius > radii[-1]


def brute_scores(rows, order=lm_score.ORDER, weight=lm_score.WEIGHT):
    """Recursive estimates over plain counts."""
    def grams(t):
        s = [0] * (order - 1) + [ord(c) + 1 for c in t]
        return [tuple(s[i : i + order]) for i in range(len(t))]

    counts = {m: [Counter() for _ in range(order + 1)] for m in "tb"}
    for text, good in rows:
        for g in grams(text or ""):
            for m in "tb" if good else "b":
                for k in range(order + 1):
                    counts[m][k][g[order - k :]] += 1
    vocabulary = len(counts["b"][1]) + 1
    contexts = {m: [Counter() for _ in range(order + 1)] for m in "tb"}
    for m in "tb":
        for k in range(1, order + 1):
            for g, n in counts[m][k].items():
                contexts[m][k][g[:-1]] += n

    def p(m, g):
        if not g:
            return 1 / vocabulary
        k = len(g)
        return (counts[m][k][g] + weight * p(m, g[1:])) / (contexts[m][k][g[:-1]] + weight)

    out = []
    for text, _ in rows:
        gs = grams(text or "")
        loss = {m: sum(-math.log(p(m, g)) for g in gs) for m in "tb"}
        out.append((len(gs), (loss["t"] - loss["b"]) / len(gs) if gs else None))
    return out


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK", 700)
    values = [t if t is None else t[:400] for t in fixtures.texts(25)]
    rows = fixtures.rows(values)
    labels = spark.createDataFrame([(d, i % 3 == 0, 0) for i, (d, *_) in enumerate(rows)] + [(rows[0][0], True, 0), (None, True, 0), (-5, True, 1)], "doc_id long, q boolean, toxic int").select("doc_id", F.col("q").cast("int").alias("quality"), "toxic")
    docs = lm_score.labelled(fixtures.frame(spark, values), labels)
    got = {r.doc_id: r for r in lm_score.score_documents(docs, F.col("is_target")).collect()}
    want = brute_scores([(t, i % 3 == 0) for i, (_, t, *_) in enumerate(rows)])
    assert len(got) == len(rows)
    for (d, *_), (n, score) in zip(rows, want):
        assert got[d].n_tokens == n
        assert (got[d].score is None) == (score is None)
        if score is not None:
            assert abs(got[d].score - score) < 1e-6


def test_score_tells_target_like_texts(spark):
    docs = spark.createDataFrame([(i, ("the wand of " if i % 2 else "zqx vkj pfw ") * 20) for i in range(40)] + [(100, "of the wand"), (101, "pfw zqx")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm_score.score_documents(docs, (F.col("doc_id") % 2 == 1) & (F.col("doc_id") < 100)).collect()}
    assert got[100] < got[101]
    assert lm_score.score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_ngrams_of_many_symbols_are_told_apart():
    """More symbols than fit in packed numbers."""
    text = "".join(map(chr, [*range(0x10, 0xD800, 3), *range(0xE000, 0x30000, 2)])) * 2 + "\U0001f642\U0001f643\uffff\U00010000"
    assert len(set(text)) > 1 << 16
    seen = Counter()
    for grams, _, sizes in lm_score.blocks([text, "\U0001f643a", None]):
        assert sizes.sum() == len(grams.number)
        for n, c in zip(np.bincount(grams.number).tolist(), zip(grams.context.tolist(), grams.symbol.tolist())):
            seen[c] += n
    want = Counter()
    for t in (text, "\U0001f643a"):
        s = [0] * 3 + [ord(c) + 1 for c in t]
        want.update(((s[k - 3] << 42) + (s[k - 2] << 21) + s[k - 1], s[k]) for k in range(3, len(s)))
    assert seen == want
    for texts in ([text, "\U0001f643a"], ["abcab", "abc", ""]):
        marks = [i == 1 for i in range(len(texts))]
        counted = {(c, s): (a, b) for g, _, _ in lm_score.blocks(texts, marks) for c, s, a, b in zip(*(x.tolist() for x in (g.context, g.symbol, g.all, g.some)))}
        numbered = {}
        for g, of, sizes in lm_score.blocks(texts):
            for k, t in zip(g.number.tolist(), np.repeat(of, sizes).tolist()):
                a, b = numbered.get((int(g.context[k]), int(g.symbol[k])), (0, 0))
                numbered[int(g.context[k]), int(g.symbol[k])] = (a + 1, b + marks[t])
        assert counted == numbered


def test_scores_in_packs_equal_scores_at_once(spark, monkeypatch):
    docs = fixtures.frame(spark)
    scores = lambda: {r.doc_id: r for r in lm_score.score_documents(docs, F.col("doc_id") % 2 == 1).collect()}
    whole = scores()
    monkeypatch.setattr(lm_score, "PACK", 700)
    parts = scores()
    assert set(whole) == set(parts)
    for k, r in whole.items():
        assert parts[k].n_tokens == r.n_tokens and (r.score is None or abs(parts[k].score - r.score) < 1e-9)
