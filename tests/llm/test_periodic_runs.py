import hashlib
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tests.llm import fixtures
from tests.oracle import ROOT
from tidewater.llm import periodic_runs as p, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Runs by comparing every word with that p places on, for every p."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted(((a, size, q) for (a, size), q in found.items()), key=lambda t: (t[0], t[2]))


def collapsed(words, runs):
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_suffix_order_prefixes_and_extensions():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (2, 1), (50, 1), (200, 2), (300, 5), (97, 40)):
        s = r.integers(0, k, n)
        t = s.tolist()
        order = p.suffix_array(s)
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])

        def lce(a, b):
            c = 0
            while max(a, b) + c < n and t[a + c] == t[b + c]:
                c += 1
            return c

        assert p.common_prefixes(s, order).tolist()[1:] == [lce(a, b) for a, b in zip(order, order[1:])]
        if n > 1:
            a = r.integers(0, n, 400)
            b = (a + r.integers(1, n, 400)) % n
            assert p.Extensions(s)(a, b).tolist() == [lce(x, y) for x, y in zip(a.tolist(), b.tolist())]


def test_runs_equal_brute_force():
    r, seen = random.Random(8), 0
    for _ in range(80):
        texts = []
        for _ in range(r.randrange(1, 6)):
            w = [r.randrange(r.choice([1, 2, 3, 30])) for _ in range(r.randrange(150))]
            for _ in range(r.randrange(4)):
                if w:
                    a, q = r.randrange(len(w)), r.randrange(1, 20)
                    w[a:a] = w[a : a + q] * r.randrange(2, 20)
            texts.append(w)
        sizes = np.array([len(w) for w in texts])
        s = np.array([x for w in texts for x in w], np.int64)
        got = p.find_runs(s, np.cumsum(sizes) - sizes, sizes) if len(s) else np.zeros((0, 4))
        want = [(i, *run) for i, w in enumerate(texts) for run in brute(w)]
        assert [tuple(t) for t in got.tolist()] == want
        seen += len(want)
    assert seen > 200


def test_grids_in_small_blocks(monkeypatch):
    grid = p.grid
    monkeypatch.setattr(p, "grid", lambda starts, sizes: grid(starts, sizes, most=7))
    w = [0, 1, 2] * 40 + list(range(3, 60)) + [5] * 30
    got = p.find_runs(np.array(w), np.array([0]), np.array([len(w)]))
    assert [tuple(t[1:]) for t in got.tolist()] == brute(w)


def test_documents(spark):
    texts = [*fixtures.texts(), "a " * 23, "a " * 24, "\x1c " * 30, "x " * 30, "a\tb\nc\r" * 9 + "d", "ab " * 60_000, " ".join("abcdefgh" * 3) + " x"]
    got = {r.doc_id: r for r in p.runs_of(fixtures.frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts[:-2]):
        words = WORD.findall(t or "")
        runs = brute(words) if len(words) < 2000 else [(0, len(words), 1)]
        r = got[3 * i + 1]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(words), runs, collapsed(words, runs))
    assert [tuple(x) for x in got[3 * (len(texts) - 2) + 1].runs] == [(0, 60_000, 1)]
    assert [tuple(x) for x in got[3 * (len(texts) - 1) + 1].runs] == [(0, 24, 8)]
    assert p.runs_of(fixtures.empty(spark)).count() == 0
    assert p.runs_of(spark.createDataFrame([(None, "a " * 30), (None, None)], "doc_id long, text string")).count() == 2


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="the test tables aren't there")
def test_query_equals_brute_force(spark):
    sf = f"{ROOT}/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op13_harmonic_runs(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_runs > 0 for r in got) >= 10
    for r in got:
        words = WORD.findall(texts[r.doc_id])
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % q] for i in range(n)]
        elif n > 3000:
            continue  # too long for brute force
        runs = brute(words)
        best = min(runs, key=lambda t: (-Fraction(t[1], t[2]), t[0], t[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (len(runs), want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
