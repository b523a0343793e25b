"""The registered queries of this subpackage: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewater.llm import backtrack_bpe, bestfit_packing, content_store, langid, lm_score, marked_words, multi_index, periodic_runs, secret_crf, shuffle_shards, simhash, vector_codes, winnowing
from tidewater.llm.common import fresh_path, tune

JSON_VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every text, read back from the files. Null and empty texts have the end id alone; repeated ids and rows have an entry each."""
    path = fresh_path(spark, "store")
    content_store.write_store(documents(spark, sf_dir), path, public_tokenizers.path(JSON_VOCABULARY), end_id=0)
    return content_store.read_index(spark, path)


def op2_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text. Null and empty texts have no ids; repeated rows are encoded each."""
    return backtrack_bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS), digests_only=True)


def op5_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text and its place in a sequence. Null and empty texts have one piece, the end id; repeated rows have pieces each."""
    return bestfit_packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(JSON_VOCABULARY))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row by the law `rows`. Null texts have 16 bytes; repeated rows have a slot each."""
    docs = documents(spark, sf_dir)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shuffle_shards.shuffle_into_shards(rows, 40, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text. Null texts and texts without a letter are `und`; repeated rows count once in training and have a prediction each."""
    docs = documents(spark, sf_dir).withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.train(docs, ~F.col("held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"])


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see `winnowing.compare_with_edits`. Null texts count as empty."""
    return winnowing.compare_with_edits(documents(spark, sf_dir))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every row whose vec_id is divisible by 20; see `multi_index.nearest` for nulls, ties and repeated ids."""
    return multi_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and score of every text against texts of quality 1. Null and empty texts have nulls; repeated rows count each."""
    docs = lm_score.labelled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return lm_score.score_documents(docs, F.col("is_target"))


def op9_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text. Texts without words have fingerprint zero and are linked like any others; repeated rows are copies."""
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every text. Null and empty texts have none; repeated rows have theirs each."""
    docs = documents(spark, sf_dir)
    return secret_crf.scan(docs, secret_crf.train(docs))


def op11_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that `vector_codes.compress` keeps."""
    found = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = vector_codes.with_label_error(found.rows)
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(found.books.digest()).alias("codebooks_sha256"))


def op12_marked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; see `marked_words.encode_documents`."""
    return marked_words.encode_documents(documents(spark, sf_dir), public_tokenizers.path(PIECES), digests_only=True)


def repeated_words(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words to take in every tenth document by the checksum of its id: from a place on they repeat. A null id has none."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def op13_harmonic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest run of every text and digests of all its runs and of the text without repeats; see `periodic_runs.runs_of`."""
    found = periodic_runs.runs_of(documents(spark, sf_dir), repeated_words)
    # exact comparison of length / period: larger first, then the smaller start and period
    crossed = lambda a, b: b["length"] * a["period"] - a["length"] * b["period"]
    ahead = lambda a, b: F.when(crossed(a, b) != 0, crossed(a, b)).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
    best = F.get(F.array_sort("runs", lambda a, b: F.signum(ahead(a, b)).cast("int")), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    some = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return some.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("(1000 * best.length) div best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_content_store, op2_backtracking_bpe, op3_language_id, op4_winnowing, op5_bestfit_packing, op6_hypergeometric_shards,
        op7_multi_index_hashing, op8_cross_entropy_difference, op9_simhash_components, op10_secret_crf,
        op11_yinyang_codes, op12_marked_words, op13_harmonic_runs,
    )
}

#: Two rounds of Lloyd and a last assignment by comparing all parts with all entries. All sums stay below 2^53, so doubles are exact.
_YINYANG = """
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER (ORDER BY vec_id) - 1 AS rn
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
width AS (SELECT max(len(v)) // 16 AS size FROM kept),
parts AS MATERIALIZED (SELECT vec_id, rn, label, part, v[part * size + 1:part * size + size] AS x FROM kept, width, range(16) AS t(part)),
c0 AS (SELECT part, rn AS entry, x AS c FROM parts WHERE rn < 64),
a0 AS MATERIALIZED (SELECT vec_id, rn, label, part, x, min({'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': entry}) AS m
    FROM parts JOIN c0 USING (part) GROUP BY ALL),
m0 AS (SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (SELECT part, m.e AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a0, width, range(1, size + 1) AS t(i) GROUP BY ALL) GROUP BY ALL),
c1 AS MATERIALIZED (SELECT part, entry, coalesce(m0.c, c0.c) AS c FROM c0 LEFT JOIN m0 USING (part, entry)),
a1 AS MATERIALIZED (SELECT vec_id, rn, label, part, x, min({'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': entry}) AS m
    FROM parts JOIN c1 USING (part) GROUP BY ALL),
m1 AS (SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (SELECT part, m.e AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a1, width, range(1, size + 1) AS t(i) GROUP BY ALL) GROUP BY ALL),
c2 AS MATERIALIZED (SELECT part, entry, coalesce(m1.c, c1.c) AS c FROM c1 LEFT JOIN m1 USING (part, entry)),
a2 AS MATERIALIZED (SELECT vec_id, rn, label, part, x, min({'d': (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c))::BIGINT, 'e': entry}) AS m
    FROM parts JOIN c2 USING (part) GROUP BY ALL),
done AS (SELECT vec_id, label, rn, string_agg(format('{:02x}', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a2 GROUP BY ALL),
books AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM c2, width, range(1, size + 1) AS t(i))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM done, books
"""

ORACLES: dict[str, str] = {"op11_yinyang_codes": _YINYANG}
