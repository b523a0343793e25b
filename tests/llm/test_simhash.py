import random
import re
import sys

import numpy as np
import xxhash

from tests.llm import fixtures
from tidewater.llm import simhash
from tidewater.llm.components import components


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    root = {d: d for d, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, f) in enumerate(pairs):
        for b, g in pairs[:i]:
            if (f ^ g).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def edited(values, seed=1):
    r, out = random.Random(seed), []
    for t in values:
        words = (t or "").split(" ")
        for _ in range(3):
            words[r.randrange(len(words))] = "zz"
            out.append(" ".join(words))
    return out


def test_components_equal_brute_force(spark):
    values = fixtures.texts()
    values = values + edited([t for t in values if t and len(t) > 400])
    want = {d: brute_fingerprint(t) for d, t, *_ in fixtures.rows(values)}
    got = simhash.near_duplicates(fixtures.frame(spark, values)).withColumn("hex", simhash.as_hex("fp")).collect()
    assert {r.doc_id: r.hex for r in got} == {d: f"{f:016x}" for d, f in want.items()}
    assert {r.doc_id: r.component_id for r in got} == brute_components(sorted(want.items()))
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def clustered(n, seed, flips=3):
    r, centers = random.Random(seed), [random.Random(seed + i).getrandbits(64) for i in range(4)]
    out = set()
    while len(out) < n:
        f = r.choice(centers)
        for _ in range(r.randint(0, flips)):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


def test_links_span_all_components(spark, monkeypatch):
    values = clustered(700, 5, flips=6) + [0, 1, 3, (1 << 64) - 1]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in values], "fp long")
    for hot in (4096, 3):
        monkeypatch.setattr(simhash, "HOT", hot)
        found = components(simhash.linked_pairs(frame)).collect()
        root = {r.node % (1 << 64): r.root % (1 << 64) for r in found}
        groups = {}
        for f in values:
            groups.setdefault(root.get(f, f), set()).add(f)
        brute = {}
        for f, g in brute_components([(f, f) for f in values]).items():
            brute.setdefault(g, set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_bit_slices_equal_popcounts():
    fps = np.array(clustered(300, 9), np.uint64)
    planes = simhash.bit_planes(fps)
    for radius in (0, 1, 2, 3, 5, 9):
        row, word = np.repeat(np.arange(300), 5), np.tile(np.arange(5), 300)
        r, w, lanes = simhash.near_lanes(fps, planes, row, word, radius)
        got = {(int(a), int(b) * 64 + i) for a, b, m in zip(r, w, lanes) for i in range(64) if int(m) >> i & 1 and int(b) * 64 + i < 300}
        assert got == {(i, j) for i in range(300) for j in range(300) if (int(fps[i]) ^ int(fps[j])).bit_count() <= radius}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
    assert components(edges.filter("a < 0")).count() == 0


def similar(seed=2, n=25):
    r, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(r.randint(120, 300))]
        rows.append((10 * i, " ".join(words)))
        for k in range(1, 4):
            changed = list(words)
            for at in r.sample(range(len(words)), max(1, len(words) // 100)):
                changed[at] = "zz"
            rows.append((10 * i + k, " ".join(changed)))
        half = words[: len(words) // 2] + ["".join(r.choice("klmnop") for _ in range(5)) for _ in range(len(words) // 2)]
        rows.append((10 * i + 5, " ".join(half)))
    return rows


def test_the_driver_collects_garbage_in_every_star_round(spark, few_partitions, monkeypatch):
    module, calls = sys.modules["tidewater.llm.components"], []
    write = module.materialize
    monkeypatch.setattr(module, "materialize", lambda *a: calls.append("write") or write(*a))
    monkeypatch.setattr(module, "let_go", lambda spark: calls.append("let go"))
    got = {tuple(r) for r in components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(10)}
    assert calls[0] == "write" and len(calls) > 4 and calls[1:] == ["write", "let go"] * (len(calls) // 2)


def test_one_of_each_similar_group_stays(spark):
    rows = similar()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(d for d, _ in rows if d % 10 in (0, 5))


def test_clashing_hashes_are_told_apart(spark):
    hashed = spark.createDataFrame([(1, 10), (1, 10), (2, 20), (2, 21), (2, 21), (3, 30)], "h1 long, h2 long")
    got = hashed.select("h1", "h2", simhash.distinct_marks(hashed).alias("mark")).collect()
    by = {(r.h1, r.h2): r.mark for r in got}
    assert len(set(by.values())) == 4 and by[1, 10] == 1 and by[3, 30] == 3 and by[2, 20] != by[2, 21]


def test_keep_one_keeps_columns_with_its_own_names(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", 7, 8), (1, "a b c d e f", 5, 6), (None, "x y", 1, 2), (1, "a b c d e f", 5, 6)], "doc_id long, text string, _row long, _keep_of long")
    assert sorted((r.doc_id or 0, r._row, r._keep_of) for r in simhash.keep_one(docs).collect()) == [(0, 1, 2), (1, 5, 6)]
    assert simhash.keep_one(docs.limit(0)).count() == 0
