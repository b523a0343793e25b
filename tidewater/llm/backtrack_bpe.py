"""Byte-level BPE by longest matches and backtracking (operator 2).

The vocabulary's byte strings become Latin-1 strings in an Aho-Corasick automaton. A word's encoding is built from
left to right with the longest match first. A token may follow another only if the merges, applied to their joint
bytes, leave exactly these two; that compatibility is kept for each pair. A prefix of a word has one encoding whose
tokens are all compatible, so a position that was left once by backtracking never needs a second visit.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewater.llm.common import tune
from tidewater.llm.wordpieces import PieceEncoder, little_endian

NEVER = 1 << 62


class BacktrackingBPE:
    """Exact byte-pair encoding over ranks: rank order is merge order and a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], memory: int = 1_000_000):
        self.ids = {t.decode("latin-1"): i for t, i in ranks.items()}
        self.text = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.memory = memory
        self.pairs: dict[int, bool] = {}
        self.left: dict[int, list[tuple[str, int]]] = {}
        self.right: dict[int, list[tuple[str, int]]] = {}

    def _halves(self, token: str) -> tuple[str, str]:
        """The two parts whose merge makes a token."""
        parts = list(token)
        while len(parts) > 2:
            ranks = [self.ids.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            i = ranks.index(min(ranks))
            if ranks[i] == NEVER:
                raise ValueError(f"the merges don't make the token {token!r}")
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _spine(self, token: int, side: int) -> list[tuple[str, int]]:
        """What stands at one edge of a token as it is merged: each part with the rank at which it is merged further."""
        out, part, until = [], self.text[token], NEVER
        while True:
            out.append((part, until))
            if len(part) == 1:
                return out
            until = self.ids[part]
            part = self._halves(part)[side]

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of both tokens leaves these two.

        It doesn't if parts at the inner edges, at a time when both stand there, are themselves to be merged. Of
        equal ranks the left pair goes first.
        """
        key = a << 32 | b
        if (known := self.pairs.get(key)) is not None:
            return known
        if (ends := self.right.get(a)) is None:
            ends = self.right[a] = self._spine(a, 1)
        if (starts := self.left.get(b)) is None:
            starts = self.left[b] = self._spine(b, 0)
        get, ok = self.ids.get, True
        for x, x_until in ends:
            for y, y_until in starts:
                m = get(x + y)
                if m is not None and m < x_until and m <= y_until:
                    ok = False
                    break
            if not ok:
                break
        if len(self.pairs) >= self.memory:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode(self, word: bytes) -> list[int]:
        s = word.decode("latin-1")
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n = len(s)
        matches: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, found in self.automaton.iter(s):
            matches[end + 1 - found[0]].append(found)  # ends ascend, so each list ascends in length
        if not all(matches):
            raise ValueError("the vocabulary lacks single bytes")
        tokens: list[int] = []
        choice: list[tuple[int, int]] = []
        dead = bytearray(n + 1)
        at, k, compatible = 0, len(matches[0]) - 1, self.compatible
        while at < n:
            here = matches[at]
            last = tokens[-1] if tokens else None
            while k >= 0:
                size, token = here[k]
                if not dead[at + size] and (last is None or compatible(last, token)):
                    break
                k -= 1
            if k >= 0:
                tokens.append(token)
                choice.append((at, k))
                at += size
                k = len(matches[at]) - 1 if at < n else 0
            else:
                dead[at] = 1
                tokens.pop()
                at, k = choice.pop()
                k -= 1
        return tokens


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


_ENCODERS: dict[str, tuple[PieceEncoder, pa.Array]] = {}


def encoder(path: str) -> tuple[PieceEncoder, pa.Array]:
    """The encoder over a file of ranks and the bytes of each id, one for each Python worker."""
    if path not in _ENCODERS:
        ranks = read_ranks(path)
        bpe = BacktrackingBPE(ranks)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        _ENCODERS[path] = PieceEncoder(lambda w: little_endian(bpe.encode(w.encode()))), pa.array(table, pa.large_binary())
    return _ENCODERS[path]


def decode_all(sequences: list[bytes], table: pa.Array) -> list[bytes]:
    """The bytes of each sequence of little-endian ids. An id that the vocabulary lacks is an error."""
    ids = np.frombuffer(b"".join(sequences), "<u4").astype(np.int64)
    if not len(ids):
        return [b""] * len(sequences)
    joined = table.take(pa.array(ids))
    if joined.null_count:
        raise ValueError("an id isn't in the vocabulary")
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(ids) + 1]
    cuts = offsets[np.concatenate([[0], np.cumsum([len(s) // 4 for s in sequences])]).astype(np.int64)].tolist()
    data = memoryview(joined.buffers()[2])
    return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])]


def encode_documents(docs: DataFrame, ranks_path: str, digests_only: bool = False) -> DataFrame:
    """Ids of every whole text, and the bytes that they decode to.

    Returns doc_id, ids (array of int) and decoded (binary); with digests_only n_tokens, ids_sha256 and
    decoded_sha256 in their place, so that no ids leave the Python workers. Null and empty texts have no ids.
    Repeated rows are encoded each; extra columns are ignored; an empty table gives none. Decoding gives the UTF-8
    bytes of the text.
    """
    tune(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "doc_id long, ids array<int>, decoded binary"

    def run(source):
        enc, table = encoder(ranks_path)
        for batch in source:
            ids = enc.encode_array(batch.column("text"))
            texts = decode_all(ids, table)
            if digests_only:
                columns = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            else:
                columns = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(texts, pa.binary())]
                names = ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
