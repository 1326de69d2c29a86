"""Logistic mixing of hashed-context bit predictors over the spelling of words; helpers that run inside tasks.

A word is spelled byte by byte, each byte bit by bit from the highest, and ended by a space. Each predictor looks the next bit
up in a table by a hash of its context (the last 1, 2, 3, 4 or 6 bytes, or all so far; and the last 3 bytes or all so far in texts
of the same group) and of the bits of the byte that are known already. The predictions are mixed in the logistic domain by weights that a gate chooses (place of the bit, place of the
byte), trained online, and refined by a map from the mixed to the observed probability.
"""

from __future__ import annotations

import numpy as np

ORDERS = (1, 2, 3, 4, 6)
PLAIN, GROUPED = len(ORDERS) + 1, 2  # predictors that see the word alone, and those that see the group of texts too
PREDICTORS = PLAIN + GROUPED
SLOT_BITS = 19
SLOTS = 1 << SLOT_BITS
GATES = 8 * 8
LEVELS = 33  # of the map that refines, over stretched probabilities of -8 to 8
_PRIOR = 0.4
_RATE = 0.1
_LANES = 4096
#: Longer words are spelled in segments of their own, so that no lane is longer.
_SEGMENT = 48

_STEP = np.uint64(0x9E3779B97F4A7C15)
_NODE = np.uint64(0xD6E8FEB86659FD93 * int(_STEP) % 2**64)
_SALT = (np.arange(1, PLAIN + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).reshape(-1, 1)


def group_salts(groups) -> np.ndarray:
    return (np.asarray(groups, np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)


class Lanes:
    """Segments of words side by side: ``of`` is each lane's word, ``length`` its bytes, ``ends`` whether the word ends behind it."""

    def __init__(self, words: list[bytes]):
        segments, of, ends = [], [], []
        for k, w in enumerate(words):
            for i in range(0, len(w) + 1, _SEGMENT):
                part = w[i : i + _SEGMENT]
                segments.append(part)
                of.append(k)
                ends.append(i + _SEGMENT > len(w))
        length = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(length, kind="stable")
        self.segments = [segments[i] for i in order]
        self.of, self.length, self.ends = np.array(of, np.int64)[order], length[order], np.array(ends, bool)[order]

    def batches(self):
        """(word of each lane, bytes as rows, how many symbols each lane has)."""
        for i in range(0, len(self.segments), _LANES):
            own = self.segments[i : i + _LANES]
            width = len(own[-1]) + 1
            rows = np.frombuffer(b"".join(s.ljust(width) for s in own), np.uint8).reshape(len(own), width)  # ends in the space that ends the word
            yield self.of[i : i + _LANES], rows, self.length[i : i + _LANES] + self.ends[i : i + _LANES]


def _bits(rows: np.ndarray, symbols: np.ndarray, salts: np.ndarray):
    """For lanes in order of their numbers of symbols, bit by bit of each symbol: gate, first lane that still has it, the bits, and the slots of the
    plain predictors and of the grouped ones; ``salts`` has a row for each group to be asked for, and a column for each lane or one for all."""
    n = len(rows)
    prefix = np.zeros(n, np.uint64)
    for p in range(int(symbols.max(initial=0))):
        first = int(np.searchsorted(symbols, p, side="right"))
        own = rows[first:]
        prefix_own = prefix[first:]
        context = np.empty((PLAIN, n - first), np.uint64)
        h, at = np.full(n - first, _STEP), 0
        for k in range(1, ORDERS[-1] + 1):
            h = (h + (own[:, p - k].astype(np.uint64) if p >= k else np.uint64(0)) + np.uint64(1)) * _STEP
            if k in ORDERS:
                context[at] = h
                at += 1
        context[at] = prefix_own + np.uint64((p + 1) * int(_STEP) % 2**64)
        grouped = context[[2, at]] ^ (salts[:, None, first:] if salts.shape[1] > 1 else salts[:, None, :])
        context ^= _SALT
        context *= _STEP  # the last factor of the slots' hash, once a byte instead of once a bit
        grouped *= _STEP
        symbol = own[:, p].astype(np.uint64)
        node = np.ones(n - first, np.uint64)
        for b in range(8):
            bit = (symbol >> np.uint64(7 - b)) & np.uint64(1)
            known = node * _NODE
            plain, by_group = ((x + known) >> np.uint64(64 - SLOT_BITS) for x in (context, grouped))
            yield b * 8 + min(p, 7), first, bit.view(np.int64), plain.view(np.int64), by_group.view(np.int64)
            node = node << np.uint64(1) | bit
        prefix[first:] = (prefix_own ^ (symbol + np.uint64(1))) * _STEP


def _sorted(of: np.ndarray, rows: np.ndarray, symbols: np.ndarray):
    order = np.argsort(symbols, kind="stable")
    return of[order], rows[order], symbols[order]


def count_bits(words: list[bytes], groups: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Zeros and ones in each slot of each predictor, each pair of a word and its group counted once; added to ``out`` if given."""
    out = np.zeros((PREDICTORS, 2 * SLOTS), np.int32) if out is None else out
    for batch in Lanes(words).batches():
        of, rows, symbols = _sorted(*batch)
        for _, _, bit, slots, by_group in _bits(rows, symbols, group_salts(groups[of])[None, :]):
            for total, x in zip(out, (*slots, *by_group[0]), strict=True):
                np.add.at(total, x * 2 + bit, np.int32(1))
    return out


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def predictions(counts: np.ndarray) -> np.ndarray:
    """Stretched predictions of a one by slot."""
    out = np.empty((PREDICTORS, SLOTS), np.float32)
    for own, n in zip(out, counts.reshape(PREDICTORS, SLOTS, 2), strict=True):
        n = n.astype(np.float32)
        own[:] = np.log((n[:, 1] + _PRIOR) / (n[:, 0] + _PRIOR))
    return out


def without_own(counts: np.ndarray) -> np.ndarray:
    """The same by slot and bit, as they were without the one word that is being looked at, which had that bit."""
    out = np.empty((PREDICTORS, SLOTS, 2), np.float32)
    for own, n in zip(out, counts.reshape(PREDICTORS, SLOTS, 2), strict=True):
        n = n.astype(np.float32)
        less = np.maximum(n - 1, 0)
        own[:, 0] = np.log((n[:, 1] + _PRIOR) / (less[:, 0] + _PRIOR))
        own[:, 1] = np.log((less[:, 1] + _PRIOR) / (n[:, 0] + _PRIOR))
    return out.reshape(PREDICTORS, 2 * SLOTS)


class Mixer:
    """Weights by gate, and the map that refines, as sums of ones and of trials by gate and level."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, PREDICTORS + 1), 0.3, np.float32) if weights is None else weights.astype(np.float32)
        self.refine = np.zeros((GATES, LEVELS, 2)) if refine is None else refine
        self.rates = np.ones(GATES)

    def _level(self, mixed: np.ndarray) -> np.ndarray:
        return np.rint((np.clip(mixed, -8, 8) + 8) * ((LEVELS - 1) / 16)).astype(np.int64)

    def train(self, words: list[bytes], groups: np.ndarray, leave_out: np.ndarray) -> None:
        """One online pass: predict, see the bit, move the gate's weights; the rate falls with the square root of the steps."""
        for batch in Lanes(words).batches():
            of, rows, symbols = _sorted(*batch)
            for gate, _, bit, slots, by_group in _bits(rows, symbols, group_salts(groups[of])[None, :]):
                x = np.ones((PREDICTORS + 1, len(bit)), np.float32)
                for k, at in enumerate((*slots, *by_group[0])):
                    np.take(leave_out[k], at * 2 + bit, out=x[k], mode="clip")
                mixed = np.clip(self.weights[gate] @ x, -12, 12)
                self.weights[gate] += (_RATE / np.sqrt(self.rates[gate]) / max(1, len(bit))) * (x @ (bit.astype(np.float32) - squash(mixed)))
                self.rates[gate] += len(bit) / _LANES
                level = self._level(mixed)
                self.refine[gate, :, 0] += np.bincount(level, bit, LEVELS)
                self.refine[gate, :, 1] += np.bincount(level, minlength=LEVELS)

    def log_probabilities(self, words: list[bytes], groups: list[int], tables: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability in each of the groups; over all words they sum to 1."""
        centre = squash(np.linspace(-8, 8, LEVELS))
        refined = np.log((self.refine[:, :, 0] + 2 * centre) / (self.refine[:, :, 1] - self.refine[:, :, 0] + 2 * (1 - centre))).astype(np.float32)
        salts, out = group_salts(groups)[:, None], np.zeros((len(words), len(groups)))
        for batch in Lanes(words).batches():
            of, rows, symbols = _sorted(*batch)
            total = np.zeros((len(groups), len(of)))
            for gate, first, bit, slots, by_group in _bits(rows, symbols, salts):
                w = self.weights[gate]
                plain = np.full(len(bit), w[PREDICTORS])
                for k in range(PLAIN):
                    plain += w[k] * tables[k][slots[k]]
                mixed = plain + sum(w[PLAIN + k] * tables[PLAIN + k][by_group[:, k]] for k in range(GROUPED))
                mixed = np.clip(mixed, -12, 12)
                final = (mixed + refined[gate][self._level(mixed)]) / 2
                total[:, first:] -= np.log1p(np.exp(np.where(bit == 1, -final, final)))
            np.add.at(out, of, total.T)
        return out
