import hashlib
import math
import os

import numpy as np
import pytest

from tests.oracle import ROOT, difference
from tidewater.llm import queries, vector_codes as v


def by_hand(parts, entries, rounds):
    """Codes, errors and books of Lloyd with all comparisons; parts: rows, part, component."""
    books = [[list(x[p]) for x in parts[:entries]] for p in range(len(parts[0]))]

    def nearest(p, x):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p, book in enumerate(books):
            code = [nearest(p, x[p])[0] for x in parts]
            for k in range(len(book)):
                own = [x[p] for x, c in zip(parts, code) if c == k]
                if own:
                    book[k] = [sum(c) // len(own) for c in zip(*own)]
    last = [[nearest(p, x[p]) for p in range(len(books))] for x in parts]
    return [bytes(k for k, _ in r) for r in last], [sum(d for _, d in r) for r in last], books


def test_skipped_groups_never_win():
    r = np.random.default_rng(3)
    shares = []
    for trial in range(40):
        n, parts, size, k = int(r.integers(1, 200)), 3, int(r.integers(0, 5)), int(r.integers(1, 20))
        scale = int(r.choice([2, 40, 5000, 1 << 24]))
        x = r.integers(-scale, scale + 1, (n, parts, size))
        k = min(k, n)
        books = v.Codebooks.start(x[:k].transpose(1, 0, 2).copy(), 4)
        entries, state = books.entries.copy(), None
        for _ in range(4):
            if state is None:
                code, bounds, error = v.assign(x, books)
            else:
                code, bounds, error, scanned = v.reassign(x, *state, books)
                shares.append((scale, scanned / (n * parts * 4)))
            d = ((x[:, :, None, :] - entries[None]) ** 2).sum(3)
            assert (code == d.argmin(2)).all() and (error == d.min(2)).all()
            sums = {(p, e): (int((code[:, p] == e).sum()), x[code[:, p] == e, p].sum(0).tolist()) for p in range(parts) for e in set(code[:, p].tolist())}
            for (p, e), (count, total) in sums.items():
                entries[p, e] = [t // count for t in total]
            books, state = books.move(sums), (code, bounds)
            assert (books.entries == entries).all() and bounds.max(initial=0) <= v.TOP
    assert np.mean([s for scale, s in shares if scale == 5000]) < 0.5


SCHEMA = "vec_id long, embedding array<float>, label int, k0 string, code string, x int"


def table(spark, vectors):
    rows = [(None if i % 41 == 7 else i, x, None if i % 5 == 0 else i % 3, "k", "c", 1) for i, x in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_compress_equals_hand_made_lloyd(spark):
    r = np.random.default_rng(5)
    vectors = [[float(np.float32(c)) for c in r.normal(0, 0.2, 32)] for _ in range(150)]
    vectors[3], vectors[8], vectors[9] = None, [math.nan] * 32, [math.inf] + [0.0] * 31
    vectors[10] = [None] + [0.5] * 31
    vectors[11] = vectors[12] = vectors[13]  # repeated
    vectors[20], vectors[21] = [0.25] * 5, []  # short: filled with zeros
    kept = [(i, x) for i, x in enumerate(vectors) if i not in (3, 8, 9, 10)]
    keyed = sorted(kept, key=lambda t: (t[0] % 41 == 7, t[0]))
    whole = [[math.floor(256 * c) for c in x] + [0] * (32 - len(x)) for _, x in keyed]
    nulls = [i for i, _ in keyed if i % 41 == 7]
    parts = [[x[p * 2 : p * 2 + 2] for p in range(16)] for x in whole]
    codes, errors, books = by_hand(parts, 64, 2)
    found = v.compress(table(spark, vectors))
    assert found.books.entries.tolist() == books
    assert found.books.digest() == hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    want = sorted((-1 if i in nulls else i, c, e) for (i, _), c, e in zip(keyed, codes, errors))
    assert sorted((-1 if t.vec_id is None else t.vec_id, bytes(t.code), t.error) for t in found.rows.collect()) == want
    labels = {}
    for (i, _), e in zip(keyed, errors):
        labels[None if i % 5 == 0 else i % 3] = labels.get(None if i % 5 == 0 else i % 3, 0) + e
    for few in (v.FEW_LABELS, 1):  # broadcast and shuffled
        before, v.FEW_LABELS = v.FEW_LABELS, few
        try:
            assert all(t.label_error == labels[t.label] for t in v.with_label_error(found.rows).collect())
        finally:
            v.FEW_LABELS = before


def test_small_and_empty_tables(spark):
    assert v.compress(table(spark, [])).rows.count() == 0
    assert v.compress(table(spark, [None, [math.nan]])).rows.count() == 0
    empty = v.compress(table(spark, [[], []]))
    assert [(bytes(t.code), t.error) for t in empty.rows.collect()] == [(bytes(16), 0)] * 2
    few = v.compress(table(spark, [[float(i)] * 16 for i in range(5)]), rounds=0)
    assert sorted(bytes(t.code)[0] for t in few.rows.collect()) == [0, 1, 2, 3, 4] and few.books.entries.shape == (16, 5, 1)
    with pytest.raises(ValueError):
        v.compress(table(spark, [[1e30] * 16]))


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="the test tables aren't there")
def test_query_equals_sql(spark):
    assert difference(spark, "sf0.001", "op11", queries.op11_yinyang_codes, queries.ORACLES["op11_yinyang_codes"]) is None
