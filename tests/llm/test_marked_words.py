import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tests.llm import fixtures
from tests.oracle import ROOT
from tidewater.llm import marked_words as m, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_random_texts_equal_the_library(library):
    r = random.Random(4)
    signs = [" ", "  ", "▁", "a", "b", "the", "\n", "\t", "é", "日", "　", "\x00", "<s>", "</s>", "<0x0A>", "😀", "́", " the", "ing", "\r", ".", "ab" * 50, " " * 33]
    texts = [None, ""] + ["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(4000)]
    coder = m.MarkedWords(MODEL, limit=50)  # a small table, so that words leave it and come back
    for at in range(0, len(texts), 333):
        some = texts[at : at + 333]
        ids = coder.encode_all(some)
        assert [np.frombuffer(i, "<u4").tolist() for i in ids] == library.encode([t or "" for t in some], add_bos=True, add_eos=True)
        assert coder.decode_all(ids) == [(t or "").replace("▁", " ") for t in some]


def test_documents_equal_the_library(spark, library):
    got = sorted(m.encode_documents(fixtures.frame(spark), MODEL).collect())
    texts = fixtures.texts()
    assert [(r.doc_id, r.ids, r.decoded) for r in got] == [(3 * i + 1, w := library.encode(t or "", add_bos=True, add_eos=True), library.decode(w)) for i, t in enumerate(texts)]
    assert m.encode_documents(fixtures.empty(spark), MODEL).count() == 0


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    got = m.encode_documents(docs, MODEL).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in got) == [(0, "a b"), (1, ""), (1, "a b"), (1, "a b")]


def test_models_whose_pieces_cross_markers_are_refused(monkeypatch):
    class Crossing(SentencePieceProcessor):
        def id_to_piece(self, i):
            return "a▁b" if i == 300 else super().id_to_piece(i)

    monkeypatch.setattr("sentencepiece.SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError):
        m.MarkedWords(MODEL)


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="the test tables aren't there")
def test_query(spark, library):
    sf = f"{ROOT}/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op12_marked_words(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
