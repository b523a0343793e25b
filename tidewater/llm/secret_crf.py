"""Secret scans: fixed patterns and a linear-chain conditional random field (operator 10).

Words (runs without white space) are tagged as outside, begin or inside of a secret. A word's score for a tag adds
weights of its shape, of its neighbours and of the file; tag pairs have weights too, and Viterbi finds the best
tagging. A word whose score for `outside` leads by more than any two transitions can make up is outside in every
best tagging, so texts fall into short runs between such words and only these runs are decoded; the result is that
of decoding the whole text. The field is trained on stretches whose tags come from the patterns, and on stretches
into which made-up secrets of further forms are put.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.common import bounded_sample, let_go, release, tune

#: The base patterns, and the least number of characters (of group 2 for assign).
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

_HINTS = (b"passw", b"secret", b"token", b"api")
_IS_HEX = bytes(ord("1") if chr(b) in "0123456789abcdef" else ord("0") for b in range(256))

OUT, BEGIN, INSIDE = 0, 1, 2
BITS = 12
SIZE = 1 << BITS

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind, by start and then kind."""
    out: list[Span] = []
    raw = text.encode("utf-8", "surrogatepass")
    lowered = raw.lower()  # A-Z only
    if any(hint in lowered for hint in _HINTS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"1" * LEAST["hex"] in raw.translate(_IS_HEX):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- features


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) & (SIZE - 1)


_RUNS = ((re.compile("[A-Z]+"), "A"), (re.compile("[a-z]+"), "a"), (re.compile("[0-9]+"), "0"), (re.compile(r"[^\x00-\x7f]+"), "u"))
_CLASSES = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+")
_BODY = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_STEM = re.compile(r"[\"'(]*([A-Za-z_-]{1,14})[\"']*[:=]")


def _length(n: int) -> int:
    return min(n, 8) if n <= 8 else 9 + sum(n > k for k in (12, 16, 20, 28, 40))


def split_words(text: str) -> list[str]:
    """Runs without ASCII white space."""
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def is_plain(word: str) -> bool:
    """A word of letters, but perhaps for a stop or comma at its end, in lower case but perhaps for its first letter."""
    body = word[:-1] if word[-1:] in (".", ",") else word
    return body.isalpha() and (body.islower() or body[1:].islower())


def lexical(word: str) -> str:
    return word.strip(".,;()\"'").lower()[:16]


def signature(word: str, lexicon: frozenset[str] | set[str]) -> tuple[str, ...]:
    """Names of a word's features: its shape, length and mixture of characters, and the word itself if the lexicon has it."""
    known = lexical(word)
    known = f"w{known}" if known in lexicon else "w"
    if is_plain(word):
        return ("plain", f"n{_length(len(word))}", known)
    shape = word[:64]
    for pattern, mark in _RUNS:
        shape = pattern.sub(mark, shape)
    bodies = _BODY.findall(word)
    body = max(bodies, key=len) if bodies else ""
    digits = sum(map(str.isdigit, body))
    stem = _STEM.match(word)
    stem = stem[1].lower() if stem else ""
    return (
        f"s{shape[:10]}",
        f"n{_length(len(word))}",
        f"b{_length(len(body))}" + ("d" if digits else "") + ("m" if 0 < digits < len(body) else ""),
        f"c{min(len(_CLASSES.findall(body)), 12)}",
        f"x{int(bool(body) and not body.strip('0123456789abcdef'))}{_length(len(body))}",
        f"k{stem}" if stem in lexicon else "k+" if stem else "k",
        known,
    )


def lexicon_of(sample: list[list[tuple[str, int]]], least: int = 3) -> frozenset[str]:
    """Words and stems of assignments that stand in or beside secrets of the sample, and those often enough elsewhere."""
    found: dict[str, int] = {}
    for words in sample:
        tagged = [i for i, (_, t) in enumerate(words) if t != OUT]
        near = {j for i in tagged for j in (i - 1, i, i + 1) if 0 <= j < len(words)}
        for j in near:
            w = words[j][0]
            stem = _STEM.match(w)
            for x in {lexical(w), stem[1].lower() if stem else ""} - {""}:
                found[x] = found.get(x, 0) + 1
    return frozenset(x for x, n in found.items() if n >= least)


def file_slots(text: str) -> tuple[int, ...]:
    """Features of the file: how often it assigns, and its length."""
    signs = text.count("=") + text.count('":')
    return (_slot(f"f{_length(signs)}"), _slot(f"g{min(len(text).bit_length(), 20)}"))


@dataclass
class Model:
    """Weights of a word's own features, of those of the word before and after, of the file's, and of tag pairs."""

    lexicon: frozenset[str]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    file: np.ndarray
    pairs: np.ndarray


# ---- training


@dataclass
class Settings:
    """rows: the most documents in the sample that the field is fitted on; secrets: the most stretches around secrets of
    one of them, and characters: of one of their words. All three bound what the driver holds."""

    rows: int = 3000
    secrets: int = 12
    characters: int = 400
    reach: int = 8
    calm: int = 2
    rounds: int = 80
    rate: float = 0.25
    l2: float = 0.02
    seed: int = 42


def tagged_words(text: str, spans: list[Span]) -> list[tuple[str, int]]:
    """Words with tags: words that a span touches, the first of each span as begin."""
    out, at, k = [], 0, 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    started = -1
    for word in split_words(text):
        a = text.index(word, at)
        at = a + len(word)
        while k < len(merged) and merged[k][1] <= a:
            k += 1
        if k < len(merged) and merged[k][0] < at:
            out.append((word, INSIDE if started == k else BEGIN))
            started = k
        else:
            out.append((word, OUT))
    return out


def stretches(text: str, s: Settings, seed: int) -> list[list[tuple[str, int]]]:
    """Tagged words around secrets of a document, at most s.secrets of them, and some stretches from anywhere."""
    r, out = random.Random(seed), []
    words = [(w[: s.characters], tag) for w, tag in tagged_words(text, base_spans(text))]
    begins = [i for i, (_, tag) in enumerate(words) if tag == BEGIN]
    for i in begins if len(begins) <= s.secrets else sorted(r.sample(begins, s.secrets)):
        out.append(words[max(0, i - s.reach) : i + s.reach + 3])
    for _ in range(s.calm if words else 0):
        i = r.randrange(len(words))
        out.append(words[max(0, i - s.reach) : i + s.reach])
    return out


def made_up(r: random.Random) -> list[str]:
    """Words of a secret of a form that the patterns may or may not know."""
    def draw(alphabet, low, high):
        return "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))

    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digits + "abcdef", small + small.upper() + digits
    value = r.choice([draw(hexes, 16, 64), draw(mixed, 16, 48), draw(mixed + "+/", 20, 60), draw(mixed + "_-", 20, 60)])
    return r.choice([
        lambda: [f"{r.choice(['password', 'pwd', 'passphrase', 'auth', 'client_secret', 'access_key'])}{r.choice('=:')}{value}"],
        lambda: [r.choice(["token", "key", "credential", "auth_token"]), r.choice("=:"), f'"{value}"'],
        lambda: ["Authorization:", "Bearer", value],
        lambda: [f"{r.choice(['ghp_', 'sk_live_', 'xoxb-', 'glpat-', 'AIza'])}{draw(mixed, 24, 40)}"],
        lambda: ["AKIA" + draw(small.upper() + digits, 16, 16)],
    ])()


def harmless(r: random.Random) -> list[str]:
    """Words with digits or signs that aren't secrets."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    return r.choice([
        lambda: [f"https://www.example.org/a/{n(4)}/page-{n(2)}.html"],
        lambda: [f"user{n(3)}@example.com"],
        lambda: [f"+{n(2)}", n(3), n(7)],
        lambda: [f"20{n(2)}-0{n(1)}-1{n(1)}T1{n(1)}:2{n(1)}:3{n(1)}Z"],
        lambda: [f"{n(3)}.{n(2)}.{n(2)}.{n(3)}"],
        lambda: [n(16)],
        lambda: ["=", f"{n(3)};"],
        lambda: ["-" * r.randint(3, 60)],
        lambda: ["|", "=" * r.randint(3, 40), "|"],
    ])()


def enrich(sample: list[list[tuple[str, int]]], seed: int) -> list[list[tuple[str, int]]]:
    r, out = random.Random(seed), list(sample)
    calm = [x for x in sample if all(t == OUT for _, t in x)] or [[("the", OUT)] * 6]
    for i in range(max(400, len(calm) // 2)):
        base = list(calm[i % len(calm)])
        at = r.randint(0, len(base))
        if r.random() < 0.5:
            new = [(w, INSIDE if k else BEGIN) for k, w in enumerate(made_up(r))]
        else:
            new = [(w, OUT) for w in harmless(r)]
        out.append(base[:at] + new + base[at:])
    return out


def fit(sample: list[tuple[list[tuple[str, int]], tuple[int, ...]]], s: Settings) -> Model:
    """Maximum likelihood with an L2 penalty, by AdaGrad over all stretches at once."""
    sample = [x for x in sample if x[0]]
    lexicon = lexicon_of([x[0] for x in sample])
    n, width = len(sample), max((len(x[0]) for x in sample), default=1)
    gold, there = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    slots: dict[str, tuple[int, ...]] = {}
    count, feature = np.zeros(n * width, np.int32), array("h")
    for i, (words, file) in enumerate(sample):
        names = []
        for j, (w, tag) in enumerate(words):
            if w not in slots:
                slots[w] = tuple(map(_slot, signature(w, lexicon)))
            names.append(slots[w])
            gold[i, j], there[i, j] = tag, True
        for j in range(len(words)):
            mine = [*names[j], *(SIZE + x for x in (names[j - 1] if j else ())), *(2 * SIZE + x for x in (names[j + 1] if j + 1 < len(words) else ())), *(3 * SIZE + x for x in file)]
            count[i * width + j] = len(mine)
            feature.extend(mine)
    feature, at = np.frombuffer(feature, np.int16), _Places(count)
    w, pairs = np.zeros((4 * SIZE, 3)), np.zeros((3, 3))
    square_w, square_p = np.full_like(w, 1e-6), np.full_like(pairs, 1e-6)
    gold_one = np.eye(3)[gold] * there[..., None]
    both = there[:, 1:] & there[:, :-1]
    gold_pairs = np.zeros((3, 3))
    np.add.at(gold_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for _ in range(s.rounds if n else 0):
        e = _gathered(at, feature, w, n * width).reshape(n, width, 3)
        e[~there] = 0
        marginal, pair_sum = _marginals(e, pairs, there)
        d = (marginal - gold_one).reshape(-1, 3)
        gw = _gathered(feature, at, d, 4 * SIZE) + s.l2 * w
        gp = pair_sum - gold_pairs + s.l2 * pairs
        square_w += gw * gw
        square_p += gp * gp
        w -= s.rate * gw / np.sqrt(square_w)
        pairs -= s.rate * gp / np.sqrt(square_p)
    return Model(lexicon, w[:SIZE], w[SIZE : 2 * SIZE], w[2 * SIZE : 3 * SIZE], w[3 * SIZE :], pairs)


#: Features of words that are added up at a time, each with two numbers of eight bytes.
BLOCK = 1 << 18


class _Places:
    """The place of each feature: place i as often as count says, laid out only for the features that are asked for."""

    def __init__(self, count: np.ndarray):
        self.ends = np.cumsum(count)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, which: slice) -> np.ndarray:
        a, b = which.start, min(which.stop, len(self))
        low, high = np.searchsorted(self.ends, [a, b - 1], "right")
        ends = np.minimum(self.ends[low : high + 1], b) - a
        return np.repeat(np.arange(low, high + 1), np.diff(ends, prepend=0))


def _gathered(to: np.ndarray | _Places, of: np.ndarray | _Places, values: np.ndarray, size: int) -> np.ndarray:
    """For each of size places the sum of the rows of values that `of` names where `to` names the place, added in that order."""
    out = np.zeros((size, values.shape[1]))
    for a in range(0, len(to), BLOCK):
        t, o = to[a : a + BLOCK], of[a : a + BLOCK]
        low = int(t.min())
        places = np.concatenate([np.arange(int(t.max()) + 1 - low), t - low])
        for k in range(values.shape[1]):
            part = out[low : int(t.max()) + 1, k]
            part[:] = np.bincount(places, np.concatenate([part, values[o, k]]), len(part))  # sums go on from where they stood
    return out


def _marginals(e: np.ndarray, pairs: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over all stretches at once: tag marginals and expected counts of tag pairs."""
    n, width, _ = e.shape
    forward, backward, t = np.zeros_like(e), np.zeros_like(e), np.exp(pairs)
    scaled = np.exp(e - e.max(axis=2, keepdims=True))
    forward[:, 0] = scaled[:, 0] / scaled[:, 0].sum(axis=1, keepdims=True)
    for j in range(1, width):
        x = forward[:, j - 1] @ t * scaled[:, j]
        forward[:, j] = np.where(there[:, j, None], x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300), 0)
    backward[:, -1] = 1
    pair_sum = np.zeros((3, 3))
    for j in range(width - 2, -1, -1):
        x = (scaled[:, j + 1] * backward[:, j + 1]) @ t.T
        backward[:, j] = np.where(there[:, j + 1, None], x / x.sum(axis=1, keepdims=True), 1)
        joint = forward[:, j, :, None] * t * (scaled[:, j + 1] * backward[:, j + 1])[:, None, :]
        total = joint.sum(axis=(1, 2), keepdims=True)
        pair_sum += np.where(there[:, j + 1, None, None], joint / np.where(total > 0, total, 1), 0).sum(axis=0)
    marginal = forward * backward
    total = marginal.sum(axis=2, keepdims=True)
    return np.where(there[..., None], marginal / np.where(total > 0, total, 1), 0), pair_sum


def _rows(got: pa.Table) -> list[tuple]:
    """The rows of a sample, some at a time, in which equal words are one object."""
    same: dict[str, str] = {}
    return [(doc, [same.setdefault(w, w) for w in words], *more) for part in got.to_batches(1000) for doc, words, *more in zip(*(c.to_pylist() for c in part.columns))]


def train(docs: DataFrame, s: Settings | None = None) -> Model:
    """Fit on at most s.rows different documents (repeated ones count once); only bounded stretches of words come to the driver.

    Null texts are left out. Without any document the model is fitted on made-up secrets alone.
    """
    s = s or Settings()
    tune(docs.sparkSession)
    chosen = bounded_sample(docs.select("doc_id", "text").filter(F.col("text").isNotNull()), [F.col("doc_id"), F.col("text")], s.rows, s.seed)

    def run(source):
        for batch in source:
            ids, words, tags, files = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for x in stretches(text, s, (doc or 0) % (1 << 31)):
                    ids.append(doc)
                    words.append([w for w, _ in x])
                    tags.append([t for _, t in x])
                    files.append(list(file_slots(text)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32())), pa.array(files, pa.list_(pa.int32()))], ["doc_id", "words", "tags", "files"])

    got = chosen.mapInArrow(run, "doc_id long, words array<string>, tags array<int>, files array<int>").toArrow()
    rows = sorted(_rows(got), key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))
    sample = [list(zip(w, t)) for _, w, t, _ in rows]
    files = [tuple(f) for *_, f in rows] or [file_slots("")]
    more = enrich(sample, s.seed)
    del got, rows, sample
    model = fit([(x, files[i % len(files)]) for i, x in enumerate(more)], s)
    del more, files
    release()
    let_go(docs.sparkSession)
    return model


# ---- decoding


class Tagger:
    """Decodes texts; scores of a word's features are kept for a bounded number of words."""

    LIMIT, AT_ONCE = 150_000, 500

    def __init__(self, model: Model):
        self.m = model
        self.reach = 2 * float(model.pairs.max() - model.pairs.min())
        self.rows: dict[str, int] = {}
        self.signatures: dict[tuple[str, ...], int] = {}
        self.plain: dict[tuple[int, str], int] = {}
        self.table = np.zeros((1024, 9), np.float32)

    def _row(self, word: str) -> int:
        names = signature(word, self.m.lexicon)
        row = self.signatures.get(names)
        if row is None:
            row = self.signatures[names] = len(self.signatures)
            if row == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            slots = np.array([_slot(x) for x in names])
            self.table[row] = np.concatenate([w[slots].sum(axis=0) for w in (self.m.own, self.m.before, self.m.after)])
        return row

    def row_of(self, words: list[str]) -> np.ndarray:
        """The row of the table with each word's scores. Rows are few: one for each combination of features."""
        if len(self.rows) + len(words) > self.LIMIT:
            self.rows.clear()
        if len(self.signatures) > self.LIMIT:
            self.signatures.clear()
            self.rows.clear()
            self.plain.clear()
        rows, plain, lexicon, out = self.rows, self.plain, self.m.lexicon, []
        for w in words:
            r = rows.get(w)
            if r is None:
                if is_plain(w):  # all plain words of a length that aren't in the lexicon are alike
                    known = w.strip(".,").lower()
                    key = (len(w), known if known in lexicon else "")
                    r = plain.get(key)
                    if r is None:
                        r = plain[key] = self._row(w)
                else:
                    r = self._row(w)
                rows[w] = r
            out.append(r)
        return np.array(out, np.int64)

    def scores(self, rows: np.ndarray, starts: np.ndarray, files: np.ndarray) -> np.ndarray:
        """Scores of all words of several texts: starts has where each text starts, files the texts' own scores."""
        t = self.table[rows]
        e = t[:, 0:3].copy()
        e[1:] += t[:-1, 3:6]
        e[:-1] += t[1:, 6:9]
        inner = starts[(starts > 0) & (starts < len(rows))]
        inner = np.unique(inner)
        e[inner] -= t[inner - 1, 3:6]  # a text's neighbours end with it
        e[inner - 1] -= t[inner, 6:9]
        return e + files

    def viterbi(self, e: np.ndarray, first: bool, last: bool) -> list[int]:
        """Best tags of a run; outside stands before and after it unless the text starts or ends there."""
        p = self.m.pairs
        best = e[0].astype(float) + (0 if first else p[OUT])
        back = []
        for row in e[1:]:
            step = best[:, None] + p
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + row
        if not last:
            best = best + p[:, OUT]
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def tag(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        """For each text the spans (start, end) of code points that the field tags; some hundred texts at a time."""
        return [spans for at in range(0, len(texts), self.AT_ONCE) for spans in self._tag(texts.slice(at, self.AT_ONCE))]

    def _tag(self, texts: pa.Array) -> list[list[tuple[int, int]]]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        values = split.values.slice(offsets[0], offsets[-1] - offsets[0])
        starts = offsets - offsets[0]
        out: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        if not len(values):
            return out
        coded = values.dictionary_encode()
        rows = self.row_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        plain = texts.to_pylist()
        files = np.array([self.m.file[list(file_slots(t))].sum(axis=0) for t in plain], np.float32)
        e = self.scores(rows, starts[:-1], np.repeat(files, np.diff(starts), axis=0))
        unsure = np.flatnonzero(e[:, OUT] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= self.reach)
        if not len(unsure):
            return out
        text_of = np.searchsorted(starts, unsure, side="right") - 1
        new = np.concatenate([[True], (np.diff(unsure) > 1) | (np.diff(text_of) > 0)])
        runs: dict[int, list[tuple[int, int]]] = {}
        heads = np.flatnonzero(new)
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(unsure)]):
            lo, hi, k = int(unsure[a]), int(unsure[b - 1]) + 1, int(text_of[a])
            tags = self.viterbi(e[lo:hi], lo == starts[k], hi == starts[k + 1])
            if any(tags):
                for j, tag in enumerate(tags):
                    if tag == BEGIN or (tag == INSIDE and (j == 0 or tags[j - 1] == OUT)):
                        runs.setdefault(k, []).append((lo + j, lo + j + 1))
                    elif tag == INSIDE:
                        runs[k][-1] = (runs[k][-1][0], lo + j + 1)
        for k, found in runs.items():
            out[k] = self._places(plain[k], values.slice(int(starts[k]), int(starts[k + 1] - starts[k])).to_pylist(), [(a - int(starts[k]), b - int(starts[k])) for a, b in found])
        return out

    @staticmethod
    def _places(text: str, words: list[str], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Code points of runs of words, without quotes and stops at their ends."""
        at, begin, end = 0, [], []
        for w in words:
            a = text.index(w, at)
            at = a + len(w)
            begin.append(a)
            end.append(at)
        out = []
        for a, b in found:
            x, y = begin[a], end[b - 1]
            while x < y and text[x] in "\"'(,;.":
                x += 1
            while x < y and text[y - 1] in "\"'),;.":
                y -= 1
            if x < y:
                out.append((x, y))
        return out


def all_spans(text: str, tagged: list[tuple[int, int]]) -> tuple[list[Span], list[Span]]:
    """The base spans, and these with the field's spans that no base span touches."""
    base = base_spans(text)
    more = [("crf", a, b) for a, b in tagged if not any(a < y and x < b for _, x, y in base)]
    return base, in_order(base + more)


def redact(text: str, spans: list[Span], mark: str = "[secret]") -> str:
    """text with each stretch that spans cover replaced by a mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _tagger(shared) -> Tagger:
    if getattr(_tagger, "of", None) != shared.id:
        _tagger.of, _tagger.made = shared.id, Tagger(shared.value)
    return _tagger.made


class _Shared:
    """A broadcast model with a name, so that a worker builds its tagger once."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def share(docs: DataFrame, model: Model) -> _Shared:
    name = hashlib.sha256(model.own.tobytes() + model.pairs.tobytes()).hexdigest()
    return _Shared(docs.sparkSession.sparkContext.broadcast(model), name)  # a fixed size: 4 x 2^12 features


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text.

    spans are kind:start:end in code points, end exclusive, by start and then kind in the order of KINDS; base
    matches are always among them. Null and empty texts have none. Repeated rows are scanned each; extra columns are
    ignored; an empty table gives none.
    """
    tune(docs.sparkSession)
    shared = share(docs, model)

    def run(source):
        tagger = _tagger(shared)
        for batch in source:
            rows = [(*(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)) for base, spans in (all_spans(t or "", tagged) for t, tagged in zip(batch.column("text").to_pylist(), tagger.tag(batch.column("text"))))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(list(c), t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(docs: DataFrame, model: Model) -> DataFrame:
    """docs with secrets in text replaced by a mark; other columns, null texts and texts without secrets stay as they are."""
    tune(docs.sparkSession)
    shared, names = share(docs, model), docs.columns

    def run(source):
        tagger = _tagger(shared)
        for batch in source:
            texts = batch.column("text").to_pylist()
            new = [None if t is None else redact(t, all_spans(t, tagged)[1]) for t, tagged in zip(texts, tagger.tag(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in names], names)
        release()

    return docs.mapInArrow(run, docs.schema)
