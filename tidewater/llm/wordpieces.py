"""Encoding of whole texts by chunks that a byte-level BPE treats independently.

A byte-level BPE applies its merges within each match of its pre-tokenizer's pattern. Wherever one space stands
between two non-space characters, a match ends before that space, so a text can be cut there and each piece be
encoded alone. Pieces repeat, so their ids are kept in a memory of bounded size.
"""

from __future__ import annotations

import array
import codecs
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the pre-tokenizer pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SPLIT = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=\S) (?=\S)")


class Memory:
    """A dict of two generations: when the newer is full, the older is dropped."""

    def __init__(self, limit: int):
        self.limit, self.new, self.old = limit, {}, {}

    def make_room(self, n: int) -> None:
        if len(self.new) + n > self.limit:
            self.old, self.new = self.new, {}


class PieceEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    encode_word gets a match of the pattern and returns its ids as bytes. whole(text), where given,
    encodes chunks with characters beyond Latin, for which the pattern of another library may differ. special: strings
    that are cut out of a text before anything else (the leftmost first, of those the longest), with their ids.
    Splitting, finding the distinct pieces of a batch and gathering their ids run in Arrow's kernels; Python
    sees each distinct piece of a batch once.
    """

    def __init__(self, encode_word: Callable[[str], bytes], whole: Callable[[str], bytes] | None = None, limit: int = 500_000, special: dict[str, bytes] | None = None):
        self.encode_word, self.whole, self.special = encode_word, whole, special or {}
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.pieces, self.words = Memory(limit), Memory(limit // 4)

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, each cut by the pattern. Words of letters after a space are kept with the pieces alone, whatever follows them."""
        self.words.make_room(len(chunks))
        self.pieces.make_room(len(chunks))
        new, old, encode, whole, out = self.words.new, self.words.old, self.encode_word, self.whole, []
        pieces, before = self.pieces.new, self.pieces.old
        for c in chunks:
            latin = c.isascii() or max(c) <= "\u024f"
            if whole and not latin:
                out.append(whole(c))
                continue
            body = c[1:] if c[:1] == " " else c
            if not latin:
                words = _SPLIT.findall(c)
            elif body is not c and body.isalpha():
                if (v := pieces.get(body)) is None:
                    v = pieces[body] = before.get(body) or encode(c)
                out.append(v)
                continue
            elif body.isalpha():
                words = (c,)
            elif body[-1:] in (".", ",") and (stem := body[:-1]).isalpha():
                if body is not c:
                    if (v := pieces.get(stem)) is None:
                        v = pieces[stem] = before.get(stem) or encode(c[:-1])
                    if (end := new.get(body[-1])) is None:
                        end = new[body[-1]] = encode(body[-1])
                    out.append(v + end)
                    continue
                words = (c[:-1], body[-1])
            else:
                words = _SPLIT.findall(c)
            ids = b""
            for w in words:
                if w[:1] == " " and (stem := w[1:]).isalpha():
                    if (v := pieces.get(stem)) is None:
                        v = pieces[stem] = before.get(stem) or encode(w)
                elif (v := new.get(w)) is None:
                    v = new[w] = old.get(w) or encode(w)
                ids = ids + v if ids else v
            out.append(ids)
        return out

    def lookup(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of distinct pieces that follow a space; None if a piece starts or ends with white space or is empty.

        New words of Latin letters are encoded first, as other pieces often start with one of them.
        """
        out = list(map(self.pieces.new.get, pieces))
        holes = [i for i, v in enumerate(out) if v is None]
        self.pieces.make_room(2 * len(holes))  # a piece, and the word it starts with
        new, old, encode, ask = self.pieces.new, self.pieces.old, self.encode_word, []
        for i in holes:
            p = pieces[i]
            if (v := old.get(p)) is None:
                if not p.isalpha() or not (p.isascii() or max(p) <= "\u024f"):
                    if p and not p[0].isspace() and not p[-1].isspace():
                        ask.append(i)
                    continue
                v = encode(f" {p}")
            out[i] = new[p] = v
        found = self.chunks([f" {pieces[i]}" for i in ask])
        new = self.pieces.new
        for i, v in zip(ask, found):
            out[i] = new[pieces[i]] = v
        return out

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts; null counts as empty."""
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy()
        coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets = offsets - offsets[0]
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self.lookup(distinct)
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        heads = self.chunks([distinct[i] for i in index[offsets[:-1]].tolist()])
        irregular = np.zeros(len(texts), bool)
        if None in ids:
            odd = np.array([v is None for v in ids])
            irregular[np.searchsorted(offsets, np.flatnonzero(odd[index]), side="right") - 1] = True
        for special in self.special:
            irregular |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        index[offsets[:-1]] = len(distinct) + np.arange(len(texts))
        table = pa.array([v or b"" for v in ids] + heads, pa.large_binary())
        gathered = table.take(pa.array(index))
        ends = np.frombuffer(gathered.buffers()[1], np.int64)[gathered.offset : gathered.offset + len(index) + 1][offsets]
        data = memoryview(gathered.buffers()[2]) if gathered.buffers()[2] is not None else memoryview(b"")
        bounds = ends.tolist()
        out = [bytes(data[a:b]) for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(irregular).tolist():
            out[i] = self._apart(texts[i].as_py())
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.large_string()))

    def _apart(self, text: str) -> bytes:
        """Ids of a text with special strings or odd spaces."""
        out, at = [], 0
        for m in self._specials.finditer(text) if self._specials else ():
            out += [*self.chunks(self._regular_chunks(text[at : m.start()])), self.special[m[0]]]
            at = m.end()
        return b"".join([*out, *self.chunks(self._regular_chunks(text[at:]))])

    @staticmethod
    def _regular_chunks(text: str) -> list[str]:
        cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:]) if b > a]


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def little_endian(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else array.array("I", ids).tobytes()


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: Latin-1 where printable, else from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def library_encoder(vocabulary: str, limit: int = 500_000) -> PieceEncoder:
    """An encoder over a file of the tokenizers library, one for each Python worker.

    Every id comes from the library's model. Special strings in a text are single ids, as in a plain call of encode.
    limit: pieces that are kept.
    """
    if (vocabulary, limit) not in _ENCODERS:
        _ENCODERS.clear()  # what another operator kept
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        added = tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        special = {t.content: little_endian([i]) for i, t in added.items()}
        model, shown = tokenizer.model, "".join(map(byte_alphabet().get, range(256)))
        model._resize_cache(0)  # the library's own memory of words; the encoder keeps them, and asks for new ones only
        tokens, decode = model.tokenize, codecs.charmap_decode

        def word(match: str) -> bytes:
            return little_endian([t.id for t in tokens(decode(match.encode(), "strict", shown)[0])])

        def whole(text: str) -> bytes:
            return little_endian(tokenizer.encode(text, add_special_tokens=False).ids)

        _ENCODERS[vocabulary, limit] = PieceEncoder(word, whole, limit, special)
    return _ENCODERS[vocabulary, limit]
