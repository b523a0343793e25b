import hashlib
import random

import numpy as np
import pytest
import xxhash

from tests.llm import fixtures
from tidewater.llm import winnowing as w


def brute_marks(text, k, span):
    c = w.code_points(text)
    if not len(c):
        return set()
    k = min(k, len(c))
    hashes = [int(w.gram_hashes(c[i : i + k], k)[0]) for i in range(len(c) - k + 1)]
    span, out = min(span, len(hashes)), set()
    for i in range(len(hashes) - span + 1):
        window = hashes[i : i + span]
        j = max(j for j, h in enumerate(window) if h == min(window))
        out.add((hashes[i + j], i + j))
    return out


def test_marks_equal_brute_force():
    r = random.Random(2)
    for k, span in ((1, 1), (3, 4), (5, 7), (12, 16), (8, 9)):
        for n in (0, 1, 2, 5, 12, 30, 200):
            text = "".join(r.choice("ab é日") for _ in range(n))
            h, p = w.winnow(w.code_points(text), k, span)
            assert {(int(a), int(b)) for a, b in zip(h, p)} == brute_marks(text, k, span) and len(h) == len(brute_marks(text, k, span))


def test_shared_passages_share_a_mark():
    r = random.Random(3)
    for _ in range(50):
        shared, a, b = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (w.GRAM + w.SPAN - 1, 90, 70))
        x, y = (set(w.winnow(w.code_points(t))[0].tolist()) for t in (a + shared + b, b + shared + a))
        assert x & y


@pytest.mark.parametrize("stretches", [1, 4, 50])
def test_rows_equal_brute_force(spark, stretches):
    values = fixtures.texts()
    got = {r.doc_id: r for r in w.compare_with_edits(fixtures.frame(spark, values), stretches).collect()}
    rows = sorted(((d, t or "") for d, t, *_ in fixtures.rows(values)), reverse=True)
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        sets = [{h for h, _ in brute_marks(t, w.GRAM, w.SPAN)} if len(t) < 4000 else {int(h) for h in w.winnow(w.code_points(t))[0]} for t in (text, new, following)]
        jaccard = [len(sets[0] & s) / len(sets[0] | s) if sets[0] | s else 1.0 for s in sets[1:]]
        assert got[doc].n_chars == len(text) and got[doc].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert abs(got[doc].near_edited - jaccard[0]) < 1e-12 and abs(got[doc].near_next - jaccard[1]) < 1e-12
        assert got[doc].fingerprint == "".join(f"{h:08x}" for h in sorted(sets[0]))


def test_few_rows_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(5, "abc"), (5, "abc"), (None, "x"), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in w.compare_with_edits(docs, 3).collect()) == ["2", "5", "5", "None", "None"]
    one = w.compare_with_edits(docs.filter("doc_id = 2 or text = 'x'").filter("doc_id is null")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(1, 1.0)]
    assert w.compare_with_edits(fixtures.empty(spark)).count() == 0


def test_an_id_with_a_third_of_all_rows_is_cut_into_stretches(spark):
    rows = [(i, f"text {i} " * 4) for i in range(200)] + [(77, f"copy {i} of a hot one " * 3) for i in range(150)] + [(None, f"no id {i} " * 5) for i in range(60)] + [(77, "same")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    marked = w.stretcher(docs, 12)(docs)
    hot = {r.stretch: r["count"] for r in marked.filter("doc_id = 77").groupBy("stretch").count().collect()}
    none = {r.stretch: r["count"] for r in marked.filter("doc_id is null").groupBy("stretch").count().collect()}
    assert len(hot) >= 3 and max(hot.values()) < 90 and len(none) >= 2
    h = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) ^ 1 << 63) - (1 << 63)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1])))
    want = []
    for i, (doc, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        new = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        want.append((str(doc), hashlib.sha256(new.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in w.compare_with_edits(docs, 12).collect()) == sorted(want)


def test_positions_of_the_comparison_are_those_of_the_marks(spark):
    docs = fixtures.frame(spark)
    marks = {r.doc_id: r.positions for r in w.fingerprint_documents(docs).collect()}
    assert {r.doc_id: r.positions for r in w.compare_with_edits(docs, 4).collect()} == marks


def test_positions_are_kept(spark):
    for r in w.fingerprint_documents(fixtures.frame(spark)).collect():
        assert len(r.hashes) == len(r.positions) and r.positions == sorted(r.positions)
