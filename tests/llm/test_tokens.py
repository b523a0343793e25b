import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm import fixtures
from tidewater.llm import backtrack_bpe, bestfit_packing, content_store, wordpieces
from tidewater.llm.common import fresh_path

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def ticked():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n, seed=3):
    r = random.Random(seed)
    parts = ["a", "b", "aa", " ", "  ", "\n", "\t", "é", "1", "'s", "日", ".", ",", "́", "²", "the", "q", "\x85", " "]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(n)]


def test_pattern_is_the_public_one():
    assert wordpieces.PATTERN == P.PATTERN


def test_pieces_equal_the_library(library):
    enc = wordpieces.library_encoder(JSON)
    values = fixtures.texts() + noise(1500)
    for text, ids in zip(values, enc.encode(values)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text


def test_words_after_a_space_are_kept_once(library):
    enc = wordpieces.library_encoder(JSON)
    asked = []
    own = wordpieces.PieceEncoder(lambda w: asked.append(w) or enc.encode_word(w), enc.whole, special=enc.special)
    values = ["x lamp lamp, lamp. lamp,", "lamp lamp", "lamp, x. lamp", "x é É, é.", "x ² ²,"]
    for text, ids in zip(values, own.encode(values)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text
    assert asked.count(" lamp") == 1 and not any(w in own.words.new for w in (" lamp", " é"))


def test_words_with_other_characters_behind_them_are_encoded_once(library):
    enc = wordpieces.library_encoder(JSON)
    asked = []
    own = wordpieces.PieceEncoder(lambda w: asked.append(w) or enc.encode_word(w), enc.whole, special=enc.special)
    values = ["x lamp!! lamp*** lamp.\nlamp's lamp, lamp", "x été.\nÉté été!! été. été7", "x lamp!! 日本, lamp2 .. ,, lamp,. ²,"]
    for _ in range(2):
        for text, ids in zip(values, own.encode(values)):
            assert np.frombuffer(ids, "<u4").tolist() == library(text), text
    assert asked.count(" lamp") == asked.count(" été") == 1 and len(asked) == len(set(asked))


def test_a_worker_holds_one_encoder():
    before = wordpieces.library_encoder(JSON)
    assert wordpieces.library_encoder(JSON) is before
    wordpieces.library_encoder(JSON, 1000)
    assert [limit for _, limit in wordpieces._ENCODERS] == [1000]


def test_special_strings_are_single_ids(library):
    enc = wordpieces.library_encoder(JSON)
    mark = "<|endoftext|>"
    values = [mark, f"a {mark} b", f"a{mark}{mark} 's  b", f" {mark}", f"{mark} ", "<|endoftext", f"日本{mark}é x <|endof", f"a  {mark}  b\n{mark}"]
    for text, ids in zip(values, enc.encode(values)):
        assert np.frombuffer(ids, "<u4").tolist() == library(text), text
    assert 50256 in library(values[1])


def test_memory_of_two_generations_keeps_results(library):
    enc = wordpieces.library_encoder(JSON)
    small = wordpieces.PieceEncoder(enc.encode_word, enc.whole, limit=8, special=enc.special)
    values = fixtures.texts()
    for at in range(0, len(values), 3):
        part = values[at : at + 3]
        for text, ids in zip(part, small.encode(part)):
            assert np.frombuffer(ids, "<u4").tolist() == library(text)


def test_backtracking_equals_merging(ticked):
    bpe = backtrack_bpe.BacktrackingBPE(backtrack_bpe.read_ranks(RANKS), memory=500)
    r = random.Random(1)
    words = [bytes(r.choice(b"aabetionsh \xc3\xa9\x00\xff") for _ in range(r.randint(1, 24))) for _ in range(3000)] + [b"a" * 500, b"ab" * 300]
    for w in words:
        assert bpe.encode(w) == ticked._encode_single_piece(w), w


def test_op2_equals_brute_force(spark, ticked):
    values = fixtures.texts()
    got = {r.doc_id: r for r in backtrack_bpe.encode_documents(fixtures.frame(spark), RANKS, digests_only=True).collect()}
    full = {r.doc_id: r for r in backtrack_bpe.encode_documents(fixtures.frame(spark), RANKS).collect()}
    assert len(got) == len(values)
    for doc, text, *_ in fixtures.rows(values):
        ids = ticked.encode_ordinary(text or "")
        assert got[doc].n_tokens == len(ids)
        assert got[doc].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
        assert full[doc].ids == ids and bytes(full[doc].decoded) == (text or "").encode()
    assert backtrack_bpe.encode_documents(fixtures.empty(spark), RANKS).count() == 0


def test_store_round_trip(spark, library):
    values, path = fixtures.texts(), fresh_path(spark, "store")
    content_store.write_store(fixtures.frame(spark), path, JSON, end_id=0)
    got = {r.doc_id: r for r in content_store.read_index(spark, path).collect()}
    back = {r.doc_id: r.ids for r in content_store.read_documents(spark, path).collect()}
    start = 0
    for doc, text, *_ in fixtures.rows(values):
        ids = library(text) + [0]
        assert (got[doc].start, got[doc].n_tokens, got[doc].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert back[doc] == ids
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_staging_holds_few_texts_at_a_time_and_sends_a_chunk_once(library, monkeypatch):
    import pyarrow as pa

    sizes, encode = [], wordpieces.PieceEncoder.encode_array
    monkeypatch.setattr(wordpieces.PieceEncoder, "encode_array", lambda self, texts: sizes.append(len(texts)) or encode(self, texts))
    values = [f"{i} " * 300 if i % 3 else "the same text " * 200 for i in range(1200)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(values))), "text": pa.array(values)})] * 2
    rows = pa.Table.from_batches(content_store._stage(JSON, 0, 2)(iter(batches))).to_pylist()
    assert max(sizes) <= 500 and sum(sizes) == 2400
    chunks = {r["digest"]: r["payload"] for r in rows if r["kind"] == 1}
    assert len(chunks) == sum(r["kind"] == 1 for r in rows)
    recipes = [r for r in rows if r["kind"] == 0]
    assert [r["doc_id"] for r in recipes] == [*range(1200)] * 2
    for i in (0, 1, 499, 500, 1199, 1200, 2399):
        assert np.frombuffer(b"".join(chunks[d] for d in recipes[i]["digests"]), "<u2").tolist() == library(values[i % 1200]) + [0]


def test_store_notices_a_changed_chunk(spark):
    path = fresh_path(spark, "store")
    content_store.write_store(fixtures.frame(spark, ["one two", "three"]), path, JSON)
    changed = spark.createDataFrame([(bytes(r.digest), b"\x01\x00" + bytes(r.payload)[2:]) for r in spark.read.parquet(f"{path}/chunks").collect()], "digest binary, payload binary")
    changed.write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="differs from its digest"):
        content_store.read_index(spark, path).collect()


TAMPERED = {
    "reversed digests": ("recipes", {"digests": "reverse(digests)"}),
    "a changed tail": ("recipes", {"tails": "transform(tails, (x, i) -> if(i = 0, x + 1, x))"}),
    "a changed length": ("recipes", {"n_tokens": "n_tokens + 1"}),
    "a changed root": ("recipes", {"root": "unhex(repeat('00', 16))"}),
    "a changed document": ("recipes", {"digests": "slice(digests, 1, 1)", "tails": "array(0L)", "root": "digests[0]"}),
    "another order": ("recipes", {"entry": "-entry"}),
    "a part's root": ("manifest", {"root": "unhex(repeat('00', 16))"}),
    "a part's start": ("manifest", {"start": "start + 5"}),
}


@pytest.mark.parametrize("name", sorted(TAMPERED))
def test_store_notices_what_was_changed(spark, name):
    path, (table, changes) = fresh_path(spark, "store"), TAMPERED[name]
    r = random.Random(5)
    texts = [" ".join(str(r.random()) for _ in range(400)), "three", "four five"]
    content_store.write_store(fixtures.frame(spark, texts, parts=1), path, JSON)
    before = spark.read.parquet(f"{path}/{table}").collect()
    assert table == "manifest" or max(len(x.digests) for x in before) > 3
    schema = spark.read.parquet(f"{path}/{table}").schema
    changed = spark.createDataFrame(before, schema).selectExpr(*[f"{changes[c]} AS {c}" if c in changes else c for c in schema.names])
    changed.write.mode("overwrite").parquet(f"{path}/{table}")
    with pytest.raises(Exception, match="differs from|can't be put together"):
        content_store.read_index(spark, path).collect()


def test_store_of_nothing(spark):
    path = fresh_path(spark, "store")
    content_store.write_store(fixtures.empty(spark), path, JSON)
    assert content_store.read_index(spark, path).count() == 0


def test_repeated_ids_have_an_entry_each(spark):
    path = fresh_path(spark, "store")
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c"), (2, None)], "doc_id long, text string")
    content_store.write_store(docs, path, JSON)
    rows = content_store.read_index(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2] and [r.start for r in rows] == [0, 3, 5, 7]


def test_chunks_do_not_depend_on_what_precedes():
    r = np.random.default_rng(0)
    shared = r.integers(0, 50000, 4000).astype("<u4")
    a, b = np.concatenate([r.integers(0, 50000, 700).astype("<u4"), shared]), np.concatenate([r.integers(0, 50000, 333).astype("<u4"), shared])
    cuts = [content_store.cut_points(x, np.array([0, len(x)]))[0] for x in (a, b)]
    tails = [{len(x) - c for c in cut} for x, cut in zip((a, b), cuts)]
    assert len(tails[0] & tails[1]) > 8
    for x, cut in zip((a, b), cuts):
        assert cut[-1] == len(x) and max(np.diff([0, *cut])) <= content_store.LONGEST


def test_crc_of_parts():
    r, shift = random.Random(2), content_store.CrcShift()
    for _ in range(50):
        parts = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 4, 100, 4097]))) for _ in range(5)]
        tails = [sum(map(len, parts[i + 1 :])) for i in range(5)]
        moved = shift(np.array([zlib.crc32(p) for p in parts]), np.array(tails))
        assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(b"".join(parts))


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, length)
        gap = gaps.pop(i) if i < len(gaps) else capacity
        n += gap is capacity and i >= len(gaps)
        if gap - length:
            bisect.insort(gaps, gap - length)
    return n


def test_packing_places_every_piece(spark, library):
    values = fixtures.texts()
    got = bestfit_packing.pack_documents(fixtures.frame(spark), JSON).collect()
    check_packing(got, 1024)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for doc, text, *_ in fixtures.rows(values):
        ids, mine = library(text) + [2], sorted(by[doc], key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and sum(r.length for r in mine) == len(ids)
        assert all(r.length == 1024 for r in mine[1:])
        for r in mine:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert bestfit_packing.pack_documents(fixtures.empty(spark), JSON).count() == 0


def test_packing_is_best_fit_decreasing(spark):
    r = random.Random(4)
    for capacity, n in ((10, 300), (64, 2000), (1024, 3000)):
        lengths = [min(capacity, 1 + int(r.expovariate(3 / capacity))) for _ in range(n)]
        pieces = spark.createDataFrame([(i, 0, 0, x, "note") for i, x in enumerate(lengths)], "doc_id long, piece int, start long, length long, note string")
        got = bestfit_packing.pack(pieces, capacity).collect()
        assert len(got) == n
        used = check_packing(got, capacity)
        assert -(-sum(lengths) // capacity) <= used <= best_fit_decreasing(lengths, capacity)


def test_packing_in_many_cells_is_nearly_best_fit(spark, monkeypatch):
    r = random.Random(12)
    lengths = [r.choice([r.randrange(1, 60), r.randrange(1, 500), r.randrange(300, 1025)]) for _ in range(8000)]
    pieces = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    used, least = {}, -(-sum(lengths) // 1024)
    for cell in (1 << 15, 128):  # one cell, and some 60
        monkeypatch.setattr(bestfit_packing, "CELL", cell)
        used[cell] = check_packing(bestfit_packing.pack(pieces, 1024).collect(), 1024)
    assert all(least <= n <= 1.005 * least for n in used.values()), (least, used)
