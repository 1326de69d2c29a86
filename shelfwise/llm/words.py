"""Words of a text as bytes, small codes for them, and 64-bit hashes: helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: 0-9, a-z and all bytes of non-ASCII characters stay, A-Z become a-z, the rest separates.
_ALNUM = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))

#: Odd multipliers for mixing 64-bit numbers (from the MurmurHash3 finaliser and the golden ratio).
M1, M2, GOLD = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def space_words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``bytes.lower`` changes A-Z alone and ``bytes.split`` splits at just these six bytes."""
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return utf8(text).translate(_ALNUM).split()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * M1
    h = h ^ (h >> np.uint64(33))
    h = h * M2
    return h ^ (h >> np.uint64(33))


class Lexicon(dict):
    """Numbers words in the order in which they come."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh, self._hashes = [], np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n

    def codes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each code, the same in every process."""
        if self.fresh:
            new = np.empty(len(self.fresh), object)
            new[:] = self.fresh
            self._hashes = np.concatenate([self._hashes, pd.util.hash_array(new, categorize=False)])
            self.fresh.clear()
        return self._hashes


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` consecutive words; none where there are fewer words."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * GOLD + h[i : i + n]
    return mix(out)


_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8, so that its powers differ in as many bits as they can
_UNBASE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
_BLOCK = 1 << 18
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base, and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _UNBASE)):
                full = np.full(n, np.uint64(base))
                full[0] = 1
                _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def prefix_hash(raw: bytes) -> np.ndarray:
    """Sums of byte numbers times powers of the base: entry i is that of the first i bytes."""
    n = len(raw)
    up, _ = powers(max(n, _BLOCK))
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(raw, np.uint8)] * up[:n], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A hash of each slice's bytes, wherever it stands."""
    _, down = powers(len(prefix))
    return mix((prefix[after] - prefix[first]) * down[first] + (after - first).astype(np.uint64) * GOLD)


def _space_before(raw: bytes, first: int, after: int) -> int:
    return max(raw.rfind(c, first, after) for c in _SPACES)


def _space_after(raw: bytes, first: int) -> int:
    return min((x for x in (raw.find(c, first) for c in _SPACES) if x >= 0), default=len(raw))


def hash_words(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of ``[^\\x20\\x09-\\x0D]+``, without making Python objects of them."""
    parts, done = [], 0
    while len(raw) - done > _BLOCK:  # blocks end at white space
        cut = _space_before(raw, done + 1, done + _BLOCK)
        cut = cut if cut > 0 else _space_after(raw, done + _BLOCK)
        parts.append(_hash_block(raw[done:cut]))
        done = cut
    return np.concatenate([*parts, _hash_block(raw[done:])])


def _hash_block(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    space = np.ones(len(raw) + 2, np.int8)
    space[1:-1] = _SPACE[np.frombuffer(raw, np.uint8)]
    step = np.diff(space)
    return slice_hash(prefix_hash(raw), np.flatnonzero(step == -1), np.flatnonzero(step == 1))


def shingles(raw: bytes, size: int) -> np.ndarray:
    """The set of hashes of ``size``-word shingles, sorted; of fewer words, the whole sequence as one."""
    h = hash_words(raw)
    if not len(h):
        return h
    return np.unique(windows(h, size) if len(h) >= size else windows(h, len(h)) + np.uint64(len(h)))
