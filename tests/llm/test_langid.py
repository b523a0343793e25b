import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from tidewater.llm import langid
from tidewater.llm.common import bounded_sample

SYLLABLES = {"en": "the and tion ing er th wh".split(), "fr": "eau que les é ment tre oi".split(), "de": "ung sch ein der ä keit ver".split()}


def corpus(spark, n=240, seed=3):
    r, rows = random.Random(seed), []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([3, 20, 100]))]
        rows.append((i, " ".join(words), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def fitted(texts, s):
    df = np.zeros(1 << s.bits)
    for text, _ in texts:
        df[langid.sparse(text, s.bits)[0]] += 1
    return langid.fit([(*langid.sparse(t, s.bits), lang) for t, lang in texts], s, df, len(texts))


def test_accuracy_and_calibration_on_held_out_rows(spark):
    docs = corpus(spark)
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs, ~out, langid.Settings(epochs=2))
    got = langid.predict(docs, model, ["doc_id", "lang"]).withColumn("held", out).collect()
    assert len(got) == 240
    for r in got:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang == r.lang_pred for r in held])) < 0.1


def test_held_out_labels_and_other_columns_are_no_inputs(spark):
    docs = corpus(spark, 120)
    out = langid.held_out(F.col("doc_id"))
    changed = docs.withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang")))
    a, b = (langid.train(d, ~out, langid.Settings(epochs=1)) for d in (docs, changed))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_odd_texts(spark):
    model = langid.train(corpus(spark, 120), F.lit(True), langid.Settings(epochs=1))
    got = {r.doc_id: r for r in langid.predict(fixtures.frame(spark), model, ["doc_id"]).collect()}
    assert len(got) == len(fixtures.texts())
    for doc, text, *_ in fixtures.rows(fixtures.texts()):
        letters = any(c.isalpha() for c in text or "")
        assert (got[doc].lang_pred == "und") == (not letters)
    assert langid.predict(fixtures.empty(spark), model, ["doc_id"]).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "the and", None), (2, None, "en"), (3, "12", "en")], "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert {r.lang_pred for r in langid.predict(docs, model, ["doc_id"]).collect()} == {"und"}


def test_blocks_do_not_change_a_prediction(monkeypatch):
    model = fitted([("the and tion " * 3, "en"), ("eau que les é", "fr")] * 10, langid.Settings(bits=10))
    text = "the eau que and " * 50
    whole = model.predict(text)
    monkeypatch.setattr(langid, "BLOCK", 7)
    assert model.predict(text)[0] == whole[0] and abs(model.predict(text)[1] - whole[1]) < 1e-9


def test_penalty_leaves_weights_zero():
    model = fitted([("the and tion", "en"), ("eau que les", "fr")] * 30, langid.Settings(bits=12))
    assert (model.weights == 0).mean() > 0.9


def test_steps_equal_those_written_out_for_each_weight():
    s, r = langid.Settings(alpha=0.7, beta=0.5, l1=0.02, l2=0.1), np.random.default_rng(3)
    z, n = np.zeros((4, 3)), np.zeros((4, 3))
    own_z, own_n = [[0.0] * 3 for _ in range(4)], [[0.0] * 3 for _ in range(4)]
    for _ in range(60):
        g = r.normal(size=(4, 3))
        w = langid.solve(z, n, s)
        for i in range(4):
            for k in range(3):
                a, b = own_z[i][k], own_n[i][k]
                one = 0.0 if abs(a) <= s.l1 else -(a - math.copysign(s.l1, a)) / ((s.beta + math.sqrt(b)) / s.alpha + s.l2)
                assert abs(one - w[i, k]) < 1e-12
                sigma = (math.sqrt(b + g[i, k] ** 2) - math.sqrt(b)) / s.alpha
                own_z[i][k], own_n[i][k] = a + g[i, k] - sigma * one, b + g[i, k] ** 2
        z, n = langid.step(z, n, w, g, s)
    assert np.allclose(z, own_z) and np.allclose(n, own_n)


def test_prediction_equals_brute_force(spark):
    docs = corpus(spark, 120)
    model = langid.train(docs, F.lit(True), langid.Settings(epochs=1))
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in langid.predict(docs, model, ["doc_id"]).collect():
        t = text[r.doc_id].lower()
        grams = [t[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)]
        number = [int(langid.ngrams(g, model.bits)[len(g) - 1][0]) for g in grams]
        z = [(sum(float(model.weights[f, k]) for f in number) / len(grams) + float(model.bias[k])) / model.temperature for k in range(len(model.languages))]
        p = [math.exp(x - max(z)) for x in z]
        best = max(range(len(p)), key=p.__getitem__)
        assert r.lang_pred == model.languages[best] and abs(r.score - p[best] / sum(p)) < 1e-6


def test_document_frequencies_cover_all_rows(spark):
    docs = corpus(spark, 90).unionByName(spark.createDataFrame([(1000, None, "en"), (1001, "12", "en")], "doc_id long, text string, lang string"))
    df, n = langid.document_frequencies(docs, 12)
    own = np.zeros(1 << 12)
    for r in docs.collect():
        if langid.has_letter(r.text):
            own[langid.sparse(r.text, 12)[0]] += 1
    assert n == 90 and np.array_equal(df, own)


@pytest.mark.parametrize("doc_id", ["CAST(NULL AS BIGINT)", "7"])
def test_sample_of_null_or_equal_ids_is_bounded_and_not_empty(spark, doc_id):
    docs = corpus(spark, 200)
    one = docs.withColumn("doc_id", F.expr(doc_id)).unionByName(docs.limit(1).withColumn("doc_id", F.expr(doc_id)).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    found = bounded_sample(one, [F.col("doc_id"), F.col("text")], 20, 42, "lang").collect()
    assert {r.lang for r in found} == set(SYLLABLES) and max(sum(r.lang == k for r in found) for k in SYLLABLES) <= 20 and len({r.text for r in found}) == len(found)
    assert langid.train(one, F.lit(True), langid.Settings(epochs=1, rows_per_language=20)).languages == sorted(SYLLABLES)
    with pytest.raises(ValueError, match="more than 2"):
        langid.train(one, F.lit(True), langid.Settings(most_languages=2))
