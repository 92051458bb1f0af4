"""Byte-level BPE ids of whole texts, with whole tokens looked up.

Before any text is read, every string of the vocabulary is tried alone: those
that the library turns into exactly the one id they stand for form the
*whole-token table*.  A pre-token found in that table needs no merges; the
merges run only for the rest, through the library's own model.

Texts go through three routes that give the same ids:

* cut at single spaces, chunk by chunk, through a table of chunks seen before
  (a cut before a space is a pre-token border unless white space stands on
  both sides of that space);
* cut by the pre-token pattern where such a space occurs;
* the library's ``encode`` on the whole text where a character lies outside
  the ranges on which the pattern engines agree, or a special token's string
  occurs, or the file isn't a plain byte-level BPE.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Characters whose class (letter, number, space, other) is the same in every
#: Unicode version the libraries use: ASCII, Latin-1 to Latin Extended-B, dashes, quotes.
_UNSURE = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]")
#: Words of those characters, none of them white space.
_SURE_WORD = "^[!-~¡-ɏ‐-‧€]+$"
#: Words that the library gets as one text.
WORDS_AT_ONCE = 256
#: A space with white space on both sides.
_INNER_SPACE = re.compile("[\t\n\r ] [\t\n\r ]")
#: Marks that are a pre-token of their own after letters, when nothing follows.
_MARKS = frozenset(".,;:!?)")
#: Bytes that a table of chunks may hold, about: those of its strings and ids, and ``_ENTRY`` for each entry's objects.
CACHE_BYTES, _ENTRY = 48 << 20, 180


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Table(dict):
    """chunk -> value, filled on first use.  Two generations of bounded size:
    a full one becomes the old one, from which what is asked for again moves
    over, so frequent chunks stay and the others go."""

    def __init__(self, make, most: int | None = None):
        super().__init__()
        self.make, self.most, self.room, self.old = make, most or CACHE_BYTES, most or CACHE_BYTES, {}

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        return self.put(chunk, value)

    def put(self, chunk, value):
        self.room -= len(chunk) + _ENTRY + (len(value) if isinstance(value, bytes) else 0)
        if self.room < 0:
            self.old = dict(self)
            super().clear()
            self.room = self.most
        self[chunk] = value
        return value

    def fill(self, found: dict) -> None:
        """Takes chunks with their values (bytes) together."""
        size = sum(map(len, found)) + sum(map(len, found.values())) + _ENTRY * len(found)
        self.room -= size
        if self.room < 0:
            self.old = dict(self)
            super().clear()
            self.room = self.most - size
        self.update(found)

    def clear(self):
        super().clear()
        self.old, self.room = {}, self.most


class ByteBpe:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                      and not pre.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
                      and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
                      and not model.get("ignore_merges"))
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        alphabet = byte_alphabet()
        self.to_model = {b: c for b, c in alphabet.items()}
        self.model = self.library.model
        self.whole = self._whole_tokens(model["vocab"], {c: b for b, c in alphabet.items()}) if self.plain else {}
        self.spaced = np.zeros(1 + max(model["vocab"].values()), bool) if self.plain else None  # ids whose string begins with a space
        if self.plain:
            self.spaced[[i for written, i in model["vocab"].items() if written[:1] == alphabet[32]]] = True
        self.piece_ids = _Table(self._piece)
        self.chunk_ids = _Table(self._chunk)
        self.chunk_sizes = _Table(lambda chunk: len(self.chunk_ids[chunk] if chunk.isalpha() else self._chunk(chunk)) // 4)

    def _whole_tokens(self, vocab: dict[str, int], byte_of: dict[str, int]) -> dict[str, int]:
        """Strings proved to encode alone as their own single id."""
        strings, ids = [], []
        for written, i in vocab.items():
            try:
                strings.append(bytes(byte_of[c] for c in written).decode("utf-8"))
                ids.append(i)
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character, or an added token
        got = self.library.encode_batch_fast(strings, add_special_tokens=False)
        return {s: i for s, i, e in zip(strings, ids, got) if e.ids == [i]}

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token: by the whole-token table, else by merges."""
        i = self.whole.get(piece)
        if i is not None:
            return i.to_bytes(4, sys.byteorder)
        if piece.isascii() and piece[0] == " " and piece[1:].isalpha():  # letters stand for themselves
            written = self.to_model[32] + piece[1:]
        else:
            written = piece.encode().decode("latin-1").translate(self.to_model)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _pre_token(self, piece: str) -> bytes:
        """Letters after a space are kept as the chunk that they are, other pre-tokens in a table of their own."""
        return self.chunk_ids[piece[1:]] if piece[0] == " " and piece[1:].isalpha() else self.piece_ids[piece]

    def _cut(self, text: str) -> bytes:
        return b"".join(map(self._pre_token, self.pattern.findall(text)))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk after its space; letters alone are one pre-token with it, and one mark after them is another."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        if chunk[-1:] in _MARKS and chunk[:-1].isalpha():
            return self.chunk_ids[chunk[:-1]] + self.piece_ids[chunk[-1]]
        return self._cut(" " + chunk)

    def word_ids(self, word: str) -> bytes:
        """As ``_chunk``, remembering nothing: for words that come once."""
        return self._piece(" " + word) if word.isalpha() else b"".join(map(self._piece, self.pattern.findall(" " + word)))

    def laid(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids one after the other: those of ``word_ids``, remembering nothing.
        Words without white space, of characters that the engines agree on, go to the library many at once with spaces
        between them: a pre-token holds a space at its beginning only, so an id that begins with one begins a word."""
        sure = np.zeros(len(words), bool)
        if self.plain and words:
            texts = pa.array(words, pa.large_string())
            marks = pc.match_substring_regex(texts, _SURE_WORD)
            for s in self.special:
                marks = pc.and_not(marks, pc.match_substring(texts, s))
            sure = marks.to_numpy(zero_copy_only=False)
        if not sure.any():
            alone = [self.word_ids(w) for w in words]
            return np.fromiter(map(len, alone), np.int64, len(alone)) // 4, np.frombuffer(b"".join(alone), np.uint32)
        some, found = [words[i] for i in np.flatnonzero(sure)], []
        for at in range(0, len(some), WORDS_AT_ONCE):
            text = " " + " ".join(some[at:at + WORDS_AT_ONCE])
            found += self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        ids = np.array(found, np.uint32)
        starts = np.flatnonzero(self.spaced[ids])
        size = np.zeros(len(words), np.int64)
        size[sure] = np.diff(starts, append=len(ids))
        if sure.all():
            return size, ids
        alone = [np.frombuffer(self.word_ids(words[i]), np.uint32) for i in np.flatnonzero(~sure)]
        size[~sure] = [len(a) for a in alone]
        out, of_sure = np.empty(size.sum(), np.uint32), np.repeat(sure, size)
        out[of_sure], out[~of_sure] = ids, np.concatenate(alone)
        return size, out

    def spelled(self, words: list[str]) -> list[bytes]:
        """Each word's ids as the table of chunks has them; what it lacks is spelled together."""
        table = self.chunk_ids
        new = [w for w in words if w not in table and w not in table.old]
        size, ids = self.laid(new)
        ends, data = [0, *(4 * np.cumsum(size)).tolist()], ids.tobytes()
        table.fill({word: data[lo:hi] for word, lo, hi in zip(new, ends, ends[1:])})
        return [table[w] for w in words]

    def forget(self) -> None:
        """Empty the tables, at the end of a task: the worker goes on to tasks of other stages."""
        for t in (self.piece_ids, self.chunk_ids, self.chunk_sizes):
            t.clear()

    def _route(self, text: str) -> str:
        if not self.plain or _UNSURE.search(text) or any(s in text for s in self.special):
            return "library"
        return "pattern" if _INNER_SPACE.search(text) else "chunks"

    def ids(self, text: str | None) -> bytes:
        """The ids as unsigned 32-bit numbers in native order."""
        if not text:
            return b""
        route = self._route(text)
        if route == "chunks":
            first, *rest = text.split(" ")
            return self._cut(first) + b"".join(map(self.chunk_ids.__getitem__, rest))
        if route == "pattern":
            return self._cut(text)
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self._route(text) == "chunks":
            first, *rest = text.split(" ")
            return len(self._cut(first)) // 4 + sum(map(self.chunk_sizes.__getitem__, rest))
        return len(self.ids(text)) // 4


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)
