import corpus_pipeline as cp
from tests.llm import fixtures
from tests.llm.test_langid import SYLLABLES
from tests.llm.test_secrets import SECRETS, slow_base
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_tokens import check_packing

import random


def documents(spark):
    r, rows = random.Random(4), []
    for i in range(160):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.choice([12, 40, 300]))]
        if i % 10 == 0:
            words.insert(5, r.choice(SECRETS[:3]))
        rows.append((i, " ".join(words), lang, "s", 1))
    rows += [(1000 + i, rows[i % 20][1], "en", "s", 1) for i in range(60)] + [(2000, None, "en", "s", None), (2001, "12 34 ...", "en", "s", 9), (2002, "", None, "s", 0)]
    rows += [(3, rows[3][1], "en", "s", 1), (None, rows[4][1], "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)


def test_each_stage_on_what_the_one_before_kept(spark):
    docs = documents(spark)
    spoken = cp.language_id(spark, docs, "")
    kept = spoken.collect()
    assert spoken.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept} == {2000, 2001, 2002}
    assert len(kept) == docs.count() - 3

    alone = cp.near_duplicates(spark, spoken, "")
    rows = alone.collect()
    assert alone.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows)
    prints = {r.doc_id: brute_fingerprint(r.text) for r in kept if r.doc_id is not None}
    assert {r.doc_id for r in rows} == set(brute_components(sorted(prints.items())).values())

    masked = cp.secrets(spark, alone, "")
    after = {r.doc_id: r for r in masked.collect()}
    assert masked.columns == docs.columns and set(after) == {r.doc_id for r in rows}
    for r in rows:
        assert not slow_base(after[r.doc_id].text) and after[r.doc_id].n_chars == len(after[r.doc_id].text)
    same = [r for r in rows if not slow_base(r.text)]
    assert sum(after[r.doc_id].text == r.text for r in same) >= 0.97 * len(same)

    packed = cp.packing(spark, masked, "").collect()
    check_packing(packed, 1024)
    assert {r.doc_id for r in packed} == set(after)


def test_odd_rows_pass_all_stages(spark):
    for docs in (fixtures.frame(spark), fixtures.empty(spark)):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, "")
            docs.collect()
