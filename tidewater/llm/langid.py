"""Language identification (operator 3).

Character n-grams (1 to 3 lower-cased code points) are hashed into a fixed number of features. A feature's value is
its share of the text's n-grams times its inverse document frequency. A multinomial logistic regression over them is
trained by follow-the-regularised-leader with L1 and L2 penalties, which leaves most weights zero, and a temperature
fitted on rows kept aside calibrates its probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewater.llm.common import bounded_sample, let_go, release, tune

#: Prediction for texts that are null or have no letter.
UNDETERMINED = "und"

_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: A text's n-grams are looked up in blocks of so many characters; blocks overlap so that none is lost.
BLOCK = 1 << 20


@dataclass
class Settings:
    """rows_per_language: the most labelled rows of each language that the classifier is fitted on; most_languages: more raise an error.

    Both bound what the driver holds: features of rows_per_language texts and their snippets for each language, and
    2^bits weights and their sums in double precision for each language.
    """

    bits: int = 16
    rows_per_language: int = 1000
    most_languages: int = 256
    snippets: int = 2
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    seed: int = 42


@dataclass
class Model:
    """weights: a row of classes for each feature, with the inverse document frequency in it."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for at in range(0, len(text), BLOCK):
            for grams in ngrams(text[max(0, at - 2) : at + BLOCK].lower(), self.bits, skip=min(at, 2)):
                total += self.weights[grams].sum(axis=0, dtype=np.float64)
                n += len(grams)
        z = (total / max(n, 1) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngrams(text: str, bits: int, skip: int = 0) -> list[np.ndarray]:
    """Feature numbers of the 1-, 2- and 3-grams; with skip, only of those that end after the first `skip` characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, h = [], np.zeros(len(c), np.uint32)
    for order in range(3):
        if len(c) <= order:
            break
        h = (h[: len(c) - order] if order == 0 else h[:-1]) * np.uint32(31) + c[order:] * _MULTIPLIERS[order] + np.uint32(order)
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append((mixed >> np.uint32(32 - bits))[max(0, skip - order) :])
    return out


def sparse(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text and the share of its n-grams that each has."""
    found, counts = np.unique(np.concatenate(ngrams(text.lower(), bits)), return_counts=True)
    return found.astype(np.int32), (counts / counts.sum()).astype(np.float32)


def snippets(text: str, n: int, seed: int) -> list[str]:
    """Short stretches of a training text, so that short texts are learnt as well."""
    r = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(r.integers(8, 120))
        at = int(r.integers(0, max(1, len(text) - size)))
        out.append(text[at : at + size])
    return [s for s in out if has_letter(s)]


def solve(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """The weights that minimise the linearised losses so far with both penalties; n: sums of squared gradients."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def step(z: np.ndarray, n: np.ndarray, w: np.ndarray, g: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """z and n after a gradient g at the weights w."""
    sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / s.alpha
    return z + g - sigma * w, n + g * g


def fit(examples: list[tuple[np.ndarray, np.ndarray, str]], s: Settings, df: np.ndarray, n_texts: int) -> Model:
    """examples: features, shares and the language; df: in how many of n_texts texts each feature is. One in five is kept for the temperature."""
    languages = sorted({lang for _, _, lang in examples})
    if not languages:
        return Model([], np.zeros((1 << s.bits, 0), np.float32), np.zeros(0), 1.0, s.bits)
    k, r = len(languages), np.random.default_rng(s.seed)
    z, n = np.zeros((1 << s.bits, k)), np.zeros((1 << s.bits, k))
    bias_z, bias_n = np.zeros(k), np.zeros(k)
    idf = np.log((1 + n_texts) / (1 + df)) + 1
    number = {lang: i for i, lang in enumerate(languages)}
    order = r.permutation(len(examples))
    aside, train = order[: len(order) // 5], order[len(order) // 5 :]

    for _ in range(s.epochs):
        for i in r.permutation(train).tolist():
            found, share, lang = examples[i]
            x = share * idf[found]
            w, b = solve(z[found], n[found], s), solve(bias_z, bias_n, s)
            e = x @ w + b
            p = np.exp(e - e.max())
            p /= p.sum()
            p[number[lang]] -= 1
            z[found], n[found] = step(z[found], n[found], w, x[:, None] * p, s)
            bias_z, bias_n = step(bias_z, bias_n, b, p, s)
    weights, bias = solve(z, n, s) * idf[:, None], solve(bias_z, bias_n, s)
    logits = np.array([examples[i][1] @ weights[examples[i][0]] + bias for i in aside.tolist()]).reshape(-1, k)
    target = np.array([number[examples[i][2]] for i in aside.tolist()], int)
    return Model(languages, weights.astype(np.float32), bias, temperature(logits, target), s.bits)


def temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The divisor of the logits that gives rows kept aside the highest likelihood."""
    if not len(target):
        return 1.0

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]).mean())

    grid = np.geomspace(0.02, 20, 120)
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def document_frequencies(docs: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """In how many of the whole texts that have a letter each feature is, and how many texts those are.

    Every task adds its texts up and sends at most 2^bits sums.
    """
    def run(source):
        df, n, seen = np.zeros(1 << bits, np.int64), 0, np.zeros(1 << bits, bool)
        for batch in source:
            for text in batch.column("text"):
                text = text.as_py()
                if has_letter(text):
                    for at in range(0, len(text), BLOCK):
                        for grams in ngrams(text[max(0, at - 2) : at + BLOCK].lower(), bits):
                            seen[grams] = True
                    found = np.flatnonzero(seen)
                    df[found] += 1
                    seen[found] = False
                    n += 1
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(df[found], n))], ["feature", "n"])
        release()

    rows = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = rows.column("feature").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(1 << bits)
    out[feature[feature >= 0]] = n[feature >= 0]
    return out, int(n[feature < 0].sum())


def train(docs: DataFrame, allowed: Column, s: Settings | None = None) -> Model:
    """Fit on the rows of docs (doc_id, text, lang) for which allowed holds and lang isn't null.

    Document frequencies come from all of these rows, whole. The weights are fitted on at most s.rows_per_language
    different rows of each language (repeated ones count once), as features and their shares; that sample and the
    frequencies are all that comes to the driver. Rows without a letter teach nothing. Without labelled rows every
    prediction is `und`. More than s.most_languages languages raise an error.
    """
    s = s or Settings()
    tune(docs.sparkSession)
    labelled = docs.filter(allowed & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n_texts = document_frequencies(labelled, s.bits)
    chosen = bounded_sample(labelled, [F.col("doc_id"), F.col("text")], s.rows_per_language, s.seed, "lang", s.most_languages)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("found", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def features(source):
        for batch in source:
            out: list[tuple] = []
            for doc, text, lang in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                if has_letter(text):
                    out += [(doc, lang, *sparse(t, s.bits)) for t in [text, *snippets(text, s.snippets, (doc or 0) % (1 << 31))]]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

    sample = chosen.mapInArrow(features, "doc_id long, lang string, found array<int>, share array<float>").toArrow().combine_chunks()
    ids, langs = sample.column("doc_id").to_pylist(), sample.column("lang").to_pylist()
    found, share_of = _lists(sample, "found"), _lists(sample, "share")
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, langs[i], len(found[i]), zlib.crc32(found[i])))
    model = fit([(found[i], share_of[i], langs[i]) for i in order], s, df, n_texts)
    del sample, found, share_of
    release()
    let_go(docs.sparkSession)
    return model


def _lists(table: pa.Table, name: str) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    out: list[np.ndarray] = []
    for chunk in table.column(name).chunks:
        offsets, values = chunk.offsets.to_numpy(), chunk.values.to_numpy(zero_copy_only=False)
        out += [values[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
    return out


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred and score (0 to 1, calibrated) from every whole text.

    Only text is an input. Null texts and texts without a letter are `und` with score 0. Rows are never dropped.
    """
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^bits weights for each language: a fixed size
    out = [c for c in docs.select(*keep, "text").schema if c.name in keep]

    def run(source):
        model = shared.value
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [model.predict(t) for t in part.column("_text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    schema = StructType([*out, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose language is predicted with a score of at least `least`; null texts and texts without a letter go.

    Repeated rows are judged each, all columns stay as they are, and an empty table stays empty.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(source):
        model = shared.value
        for batch in source:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [model.predict(t) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([lang != UNDETERMINED and score >= least for lang, score in found], pa.bool_()))
        release()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from: CRC-32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
