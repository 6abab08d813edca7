"""BPE encoding and decoding (operator 1) for byte-level vocabularies in the tokenizers library's JSON format.

Encoding is dynamic programming over the prefixes of a piece. An automaton yields the vocabulary tokens that end each
prefix; exactly one of them can end the prefix's encoding: the longest one that stands compatibly after the last token
of what precedes it. That last token is stored for each prefix, and back-pointers from the whole piece give the ids.
Two neighbours are compatible if merging their joint bytes gives the two back: their merges are undone from the last to
the first, and no pair that meets at the border on the way may have a merge that would have come earlier.

Null texts count as empty: no ids, an empty decoded text. A special token's string in a text becomes its id, as the
library has it by default. Repeated rows give repeated rows; other columns are left out. Each row stands for itself, so
there is no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import json
import re
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, texts

# The byte-level pre-tokeniser's published split pattern.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD_SPACE = re.compile(r"\s[ ]|[ ]\s")
_loaded: dict[str, "Codec"] = {}


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Codec:
    """remember: most pieces, and most pairs, whose results a worker keeps; older ones are computed again."""

    def __init__(self, path: str, remember: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.rank, self.parts, self.merge = [-1] * size, [(-1, -1)] * size, {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.merge[a, b], self.rank[whole], self.parts[whole] = rank, rank, (a, b)
        self.suffixes = ahocorasick.Automaton()
        self.split = regex.compile(PIECES).findall
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.remember, self.fits, self.whole = remember, {}, {}
        for token, i in self.id_of.items():
            if self.reachable(i):
                self.suffixes.add_word(token.decode("latin-1"), (i, len(token)))
        self.suffixes.make_automaton()
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether no merge of rank below limit, nor an earlier one between their parts, joins a and b at their border."""
        merge, rank, parts = self.merge.get, self.rank, self.parts
        while True:
            if merge((a, b), limit) < limit:
                return False
            if rank[a] > rank[b]:  # the left one was made last; where ranks are equal the left one was made first
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) >= self.remember:
                self.fits.clear()
            found = self.fits[a, b] = self._apart(a, b, 1 << 60)
        return found

    def reachable(self, t: int) -> bool:
        """Whether the token's own bytes are encoded as this one token."""
        found = self.whole.get(t)
        if found is None:
            a, b = self.parts[t]
            found = self.whole[t] = len(self.bytes_of[t]) == 1 or (a >= 0 and self.reachable(a) and self.reachable(b) and self._apart(a, b, self.rank[t]))
        return found

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece, by the last tokens of its prefixes; every byte is a token, so each prefix has one."""
        t = self.id_of.get(data)
        if t is not None and self.reachable(t):
            return [t]
        last, size = [-1] * len(data) + [-2], [0] * len(data)  # the entry at -1 stands for the empty prefix
        known, fits = self.fits.get, self.compatible
        for end, (t, n) in self.suffixes.iter(data.decode("latin-1")):
            if last[end] == -1:
                before = last[end - n]
                if before == -2 or (known((before, t)) or fits(before, t)):
                    last[end], size[end] = t, n
        out, at = [], len(data) - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        return out[::-1]

    def _ids(self, p: str) -> bytes:
        """The ids of one piece, remembered."""
        ids = self.pieces.get(p)
        if ids is None:
            found = self.piece(p.encode())
            ids = pack(f"<{len(found)}I", *found)
            if len(p) <= 32:
                if len(self.pieces) >= self.remember // 2:
                    self.pieces.clear()
                self.pieces[p] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._ids, self.split(chunk)))

    def _spaced(self, word: str) -> bytes:
        """The ids of a space and a word; one of letters alone, before a stop or comma or not, needs no splitting."""
        ids = self.older.get(word)
        if ids is None:
            if word.isalpha():
                found = self.piece(b" " + word.encode())
                ids = pack(f"<{len(found)}I", *found)
            elif word[-1:] in (".", ",") and word[:-1].isalpha():
                stem = word[:-1]
                ids = (self.spaced.get(stem) or self._spaced(stem)) + self._ids(word[-1])
            else:
                ids = self._chunk(" " + word)
        if len(word) <= 32:
            self.spaced[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        """A piece never goes past a space that stands alone, so what follows each such space is encoded, and remembered, by itself."""
        if _ODD_SPACE.search(text):
            return self._chunk(text)
        first, *words = text.split(" ")
        found = list(map(self.spaced.get, words))
        if None in found:
            found = [self._spaced(word) if ids is None else ids for word, ids in zip(words, found)]
            if len(self.spaced) >= self.remember:
                self.spaced, self.older = {}, self.spaced
        return self._chunk(first) + b"".join(found)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(np.array([self.special[x]], "<u4").tobytes() if i % 2 else self._plain(x) for i, x in enumerate(self.cut.split(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """Each worker loads a vocabulary once."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers) of every whole text; decoded adds the ids' text.

    tokenizer: path of the vocabulary file on every machine.
    """

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            ids = [c.encode(x or "") for x in b.column(1).to_pylist()]
            out = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                out.append(pa.array(map(c.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    return map_arrow(texts(docs, id_col, text_col), run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of binary ids; null: an empty text. An id beyond the vocabulary is an error."""

    def run(batches):
        c = codec(tokenizer)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or b"") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), run, "doc_id long, text string")
