"""Token ids by the tokenizers library, with each distinct chunk of text encoded once per worker.

Both vocabularies used here cut a text into pieces before merging, and each piece's ids depend on the piece alone. Where
such a cut is certain, a text is split into chunks whose ids are kept and put together again:

* ``space-led``: before a space that a visible character follows (byte-level BPE, whose pieces hold a space at most at their start);
* ``white space``: at ASCII white space (for vocabularies that drop it and lower-case all letters).

Of a chunk that ends in punctuation behind a letter, both kinds of vocabulary encode the punctuation by itself, so such a
chunk is put together from its two parts. A chunk of Latin letters alone is one piece in both, so it goes to the vocabulary's own
model, without the search for pieces. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from shelfwise.llm.words import utf8

#: A space that isn't followed by a character that is certainly visible; then chunks are cut with more care.
_ODD = re.compile(" (?:[^!-~¡-ᙿ]|$)|\x00")
_CUT = re.compile("(?= [!-~¡-ᙿ])")
_STEM = re.compile(r"([^\x00]*[A-Za-z])([!-/:-@\[-`{-~]+)")
#: Letters that both vocabularies keep together, that have one code point in small letters, and that don't compose any more.
_LETTERS = re.compile("\x00?[A-Za-zÀ-ÖØ-öø-įı-ž]+")


def byte_letters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: itself if it is visible, else one from 256 on, in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


_AS_LETTERS = byte_letters()


class CachedTokenizer(dict):
    """Chunk to its number; the ids of chunk k are ``flat[start[k]:start[k] + size[k]]``. Beyond ``most`` chunks the rare ones go."""

    def __init__(self, path: str, split: str, most: int = 300_000, most_chars: int = 16_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.split, self.most, self.most_chars = split, most, most_chars
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self.fresh: list = []
        self.chars = 0
        self.flat, self.start, self.size, self.seen = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, chunk) -> int:
        self[chunk] = n = len(self)
        self.fresh.append(chunk)
        return n

    def _chunks(self, text: str | None) -> list:
        if not text:
            return []
        if self.split == "white space":
            raw = utf8(text)
            return (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()  # a letter before a combining mark may compose when it is small
        if _ODD.search(text):
            return ["\x00" + x for x in _CUT.split(text)]  # as it stands
        first, *rest = text.split(" ")
        return ["\x00" + first, *rest]  # the rest without the space before it

    def _piece(self, text: str) -> str:
        """A chunk of letters as its vocabulary writes it."""
        if self.split == "white space":
            text = text.lower()
        else:
            text = text[1:] if text[0] == "\x00" else " " + text
            if text.isascii():
                return text.replace(" ", _AS_LETTERS[32])
        return text if text.isascii() else text.encode().decode("latin-1").translate(_AS_LETTERS)

    def _keep(self, at: list[int], size: np.ndarray, ids: np.ndarray) -> None:
        self.start[at], self.size[at] = len(self.flat) + np.cumsum(size) - size, size
        self.flat = np.concatenate([self.flat, ids])

    def _learn(self) -> None:
        """Ids of the new chunks; the parts of a chunk may be new chunks themselves."""
        known, pieces, pieces_at, whole, whole_at, parts, parts_at = len(self.size), [], [], [], [], [], []
        for code, chunk in enumerate(self.fresh, known):  # grows on the way
            is_bytes = isinstance(chunk, bytes)
            text = chunk.decode("utf-8", "surrogatepass") if is_bytes else chunk
            self.chars += len(text)
            if _LETTERS.fullmatch(text):
                pieces.append(self._piece(text))
                pieces_at.append(code)
            elif m := _STEM.fullmatch(text):
                parts += [self[m[1].encode()], self[m[2].encode()]] if is_bytes else [self[m[1]], self["\x00" + m[2]]]
                parts_at.append(code)
            else:
                whole.append(text if is_bytes else text[1:] if text[:1] == "\x00" else " " + text)
                whole_at.append(code)
        new = len(self.fresh)
        self.fresh.clear()
        self.start, self.size, self.seen = (np.concatenate([x, np.zeros(new, np.int64)]) for x in (self.start, self.size, self.seen))
        model = self.tokenizer.model.tokenize
        for at, ids in ((pieces_at, [[t.id for t in model(x)] for x in pieces]), (whole_at, [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)])):
            self._keep(at, np.fromiter(map(len, ids), np.int64, len(ids)), np.fromiter(chain.from_iterable(ids), np.uint32))
        if parts:
            self._keep(parts_at, self.size[parts].reshape(-1, 2).sum(axis=1), gather(self.flat, self.start[parts], self.size[parts]))

    def _trim(self) -> None:
        """Keeps the chunks that were seen more than twice, if they are few enough."""
        keep = np.flatnonzero(self.seen > 2)
        if self.chars > self.most_chars or len(keep) > self.most // 2:
            self._forget()
            return
        wanted = (self.seen > 2).tolist()
        chunks = [c for c, k in self.items() if wanted[k]]
        start, size = self.start[keep], self.size[keep]
        self.flat = gather(self.flat, start, size)
        self.start, self.size, self.seen = np.cumsum(size) - size, size, self.seen[keep]
        self.clear()
        self.update(zip(chunks, range(len(chunks)), strict=True))
        self.chars = sum(map(len, chunks))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self) > self.most or self.chars > self.most_chars:
            self._trim()
        codes = [np.fromiter(map(self.__getitem__, own), np.int64, len(own)) for own in map(self._chunks, texts)]
        if self.fresh:
            self._learn()
        if codes:
            self.seen += np.bincount(np.concatenate(codes), minlength=len(self.seen))
        return [gather(self.flat, self.start[c], self.size[c]) for c in codes]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` one behind the other."""
    at = np.cumsum(size)
    total = int(at[-1]) if len(at) else 0
    return flat[np.arange(total) + np.repeat(start - at + size, size)]


_OPEN: dict[tuple[str, str], CachedTokenizer] = {}


def tokenizer(path: str, split: str) -> CachedTokenizer:
    """One for each worker process."""
    if (path, split) not in _OPEN:
        _OPEN[path, split] = CachedTokenizer(path, split)
    return _OPEN[path, split]
