"""SentencePiece encoding by a table of distinct marked words (operator 12).

SentencePiece writes a space as the marker U+2581 and puts one before the text. Where no piece has a marker behind
another character, no merge reaches across such a place, so a text falls apart into marked words: a run of markers
and what follows up to the next run. Each distinct marked word is segmented once by the library, and a text's ids are
those of its words, put together in the order of their positions.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidewater.llm.common import release, tune
from tidewater.llm.wordpieces import Memory, little_endian

MARKER = "▁"
_MARKED = re.compile(" +[^ ]*")
#: Longer words are segmented where they stand and not kept, so that the table's size is bounded in bytes too.
LONGEST_KEPT = 64


class MarkedWords:
    """Encoder and decoder over a SentencePiece model; one for each Python worker.

    The table of distinct words has two generations of at most `limit` words. A model whose pieces cross markers, or
    that changes texts before it segments them, raises an error.
    """

    def __init__(self, model: str, limit: int = 300_000):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=model)
        pieces = [self.library.id_to_piece(i) for i in range(len(self.library))]
        if any(re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces):
            raise ValueError("pieces of this model cross white space markers")
        if self.library.encode("a", out_type=str)[0][0] != MARKER or self.library.normalize("Ａ  ﬁ́ ") != f"{MARKER}Ａ{MARKER}{MARKER}ﬁ́{MARKER}":
            raise ValueError("only models with a leading marker and without normalisation are supported")
        self.marker = little_endian([self.library.piece_to_id(MARKER)])
        self.begin, self.end = (little_endian([i]) for i in (self.library.bos_id(), self.library.eos_id()))
        self.table = Memory(limit)

    def _segment(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word. The library itself puts the first marker before what it gets, unless that is empty."""
        asked = [w for w in words if w != " "]
        out = dict(zip(asked, map(little_endian, self.library.encode([w[1:] for w in asked], num_threads=1)))) if asked else {}
        return out | {" ": self.marker}

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts with begin and end ids, as little-endian unsigned 32-bit integers; null counts as empty."""
        marked = [_MARKED.findall(f" {t.replace(MARKER, ' ')}") if t else [] for t in texts]
        distinct = set(chain.from_iterable(marked))
        self.table.make_room(len(distinct))
        new, old = self.table.new, self.table.old
        here = {w: v for w in distinct if (v := new.get(w) or old.get(w)) is not None}
        here |= self._segment(distinct - here.keys())
        new.update((w, v) for w, v in here.items() if len(w) <= LONGEST_KEPT)
        get = here.__getitem__
        return [b"".join([self.begin, *map(get, words), self.end]) for words in marked]

    def decode_all(self, sequences: list[bytes]) -> list[str]:
        """The texts that the library makes of ids: markers become spaces, the leading one goes, byte pieces become characters."""
        return [self.library.decode(np.frombuffer(s, "<u4").tolist()) for s in sequences]


_CODERS: dict[str, MarkedWords] = {}


def coder(model: str) -> MarkedWords:
    if model not in _CODERS:
        _CODERS[model] = MarkedWords(model)
    return _CODERS[model]


def slices(texts: pa.Array, most: int = 4 << 20):
    """Ranges of rows whose texts have at most so many bytes together, or one row each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_documents(docs: DataFrame, model: str, digests_only: bool = False) -> DataFrame:
    """Ids of every whole text, with begin and end ids, and the text that they decode to.

    Returns doc_id, ids (array of int) and decoded (string); with digests_only n_tokens, ids_sha256 and
    decoded_sha256 in their place, so that no ids leave the Python workers. Null and empty texts have the begin and
    end ids alone and decode to an empty text. Decoding gives the text back, but for U+2581, which becomes a space.
    Repeated rows and ids are encoded each, a null doc_id stays null, extra columns are ignored and an empty table
    gives none. One pass without a shuffle: a task's table of distinct words is bounded, and lost tasks run again.
    """
    tune(docs.sparkSession)
    names = ["doc_id", *(["n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else ["ids", "decoded"])]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else "doc_id long, ids array<int>, decoded string"

    def run(source):
        words = coder(model)
        for batch in source:
            texts, keys = batch.column("text"), batch.column("doc_id").cast(pa.int64())
            for a, b in slices(texts):
                ids = words.encode_all(texts.slice(a, b - a).to_pylist())
                decoded = words.decode_all(ids)
                if digests_only:
                    columns = [
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                    ]
                else:
                    columns = [pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), *columns], names)
        release()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
