"""The registered queries and the pipeline over the smallest tables, against the libraries and brute force."""

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.oracle import ROOT
from tidewater.llm import queries as q

SF = f"{ROOT}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(q.JSON_VOCABULARY))
    return {d: t.encode(x, add_special_tokens=False).ids for d, x in texts.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, ids):
    got = {r.doc_id: r for r in q.op1_content_store(spark, SF).collect()}
    start = 0
    for d in sorted(ids):
        whole = [*ids[d], 0]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(whole), crc(whole))
        start += len(whole)
    assert len(got) == len(ids)


def test_op2(spark, texts):
    import tiktoken

    from tidewater.llm.backtrack_bpe import read_ranks

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(q.RANKS)), special_tokens={})
    got = q.op2_backtracking_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_op3(spark, texts):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = q.op3_language_id(spark, SF).collect()
    assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    judged = [r.lang_pred == langs[r.doc_id] for r in got if r.held_out and langs[r.doc_id] and any(c.isalpha() for c in texts[r.doc_id])]
    assert np.mean(judged) > 0.9


def test_op4(spark, texts):
    got = {r.doc_id: r for r in q.op4_winnowing(spark, SF).collect()}
    order = sorted(texts, reverse=True)
    for d, following in zip(order, order[1:] + order[:1]):
        t, half = texts[d], len(texts[d]) // 2
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + texts[following][:half]).encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if texts[following] == t:
            assert got[d].near_next == 1 and got[d].fingerprint == got[following].fingerprint


def packed_well(rows, streams, cut=1024):
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        at = 0
        for i, r in enumerate(own):
            assert (r.piece, r.start) == (i, at) and r.ids_crc32 == crc(streams[d][at : at + r.length])
            at += r.length
        assert at == len(streams[d]) and (len(own) == 1 or all(r.length == cut for r in own[1:])) and (len(own) > 1) == (at > cut)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= cut
    return len(places)


def test_op5(spark, ids):
    streams = {d: [*i, 2] for d, i in ids.items()}
    rows = q.op5_bestfit_packing(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(ids)
    least = -(-sum(map(len, streams.values())) // 1024)
    assert packed_well(rows, streams) <= least * 1.05 + 2


def test_op6(spark, texts):
    got = q.op6_hypergeometric_shards(spark, SF).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == len(texts) and set(sizes) <= set(range(40)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(40)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode())) for r in got)


def test_op7(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    x = {i: np.array(v, float) for i, v in rows}
    got = defaultdict(list)
    for r in q.op7_multi_index_hashing(spark, SF).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    found = wanted = 0
    for i in (i for i in x if i % 20 == 0):
        best = sorted(((-float(x[i] @ v), j) for j, v in x.items() if j != i))[:20]
        own = sorted(got[i])
        assert [r for r, _, _ in own] == list(range(1, len(best) + 1)) and all(abs(s - float(x[i] @ x[j])) < 1e-9 for _, j, s in own)
        found, wanted = found + len({j for _, j in best} & {j for _, j, _ in own}), wanted + len(best)
    assert found >= 0.9 * wanted > 0


def test_op8(spark, texts):
    got = q.op8_cross_entropy_difference(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.n_tokens or 0) == len(texts[r.doc_id]) and (r.score is None) == (not texts[r.doc_id]) for r in got)
    assert all(abs(r.score - (r.loss_target - r.loss_background)) < 1e-9 for r in got if r.score is not None)


def test_op9(spark, texts):
    got = q.op9_simhash_components(spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert set(prints) == set(texts)
    parent = {d: d for d in prints}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id: r.component_id for r in got} == {d: root(d) for d in prints}


def test_op10(spark, texts):
    got = q.op10_secret_crf(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        spans = [s for s in r.spans.split(",") if s]
        base = [s for s in spans if not s.startswith("crf")]
        assert Counter(s.split(":")[0] for s in base) == Counter({k: n for k, n in (("assign", r.n_assign), ("access", r.n_access), ("hex", r.n_hex)) if n})
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert all(0 <= int(s.split(":")[1]) < int(s.split(":")[2]) <= len(texts[r.doc_id]) for s in spans)


def test_pipeline(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    streams = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        streams[r.doc_id] += list(r.ids)
    packed_well(rows, streams)
    assert set(streams) < set(texts) and len(streams) > 0.3 * len(texts)
    assert len({tuple(s) for s in streams.values()}) == len(streams)  # no two texts that stay are equal
    assert all(s[-1] == 2 for s in streams.values())
