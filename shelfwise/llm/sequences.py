"""Logistic mixing of hashed-context bit predictors over texts, token by token in their order; helpers that run inside tasks.

A token is told by bits: whether its word is known, then, for a known one, the bits of its word's cell (by a hash) from the highest. Each predictor looks the next bit up in a
table by a hash of its context and of the token's bits that are known already (nodes of NEAR bits behind one another are neighbours there, which memory fetches together); contexts are nothing, the class that the document's tokens so far speak for,
that class with the token before, and the two tokens before. The tables count every token of the training texts. The predictions are mixed in the logistic domain by weights that a gate
chooses (place of the bit), trained online by Newton's steps, and refined by a map from the mixed to the observed probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from shelfwise.llm.mixing import LEVELS, squash

CELL_BITS = 10
CELLS = 1 << CELL_BITS
PREDICTORS, FEW = 4, 2  # of them those that see no word before, and so have few contexts
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SIZE = PREDICTORS * 2 * SLOTS
GATES = 1 + CELL_BITS
NEAR = 3  # bits behind one another whose nodes have neighbouring slots
_PRIOR = 0.4
_TOKENS = 8192  # between two steps of the weights

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_NODE = np.uint64(int(_ODD) * int(_STEP) % 2**64)
_SALTS = np.arange(1, PREDICTORS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


class Tokens(NamedTuple):
    """Tokens of whole documents one behind the other: ``first`` is true where a document begins, ``leaning`` the class that its tokens so far speak for."""

    hashes: np.ndarray  # of 32 bits
    known: np.ndarray
    first: np.ndarray
    leaning: np.ndarray

    def parts(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(leaves of the cells, known, classes, contexts with words before) of ``size`` tokens each."""
        for i in range(0, len(self.hashes), size):
            s = slice(i, i + size)
            # two tokens more at the front, so that each has the two before it; 1 stands for those before a document
            own = np.concatenate([np.zeros(max(2 - i, 0), np.uint32), self.hashes[max(i - 2, 0) : i + size]]).astype(np.uint64)
            begun = np.concatenate([np.ones(max(1 - i, 0), bool), self.first[max(i - 1, 0) : i + size]])
            before = np.where(begun[1:], np.uint64(1), own[1:-1])
            last = np.where(begun[1:] | begun[:-1], np.uint64(1), own[:-2])
            one = before * _STEP
            contexts = np.stack([one ^ _of_class(self.leaning[s]), (one ^ (last * _ODD)) * _STEP])
            yield cells(self.hashes[s]) + CELLS, self.known[s], self.leaning[s].astype(np.int64), _salted(contexts, _SALTS[FEW:])


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint32(32 - CELL_BITS)).astype(np.int64)


def _of_class(classes: np.ndarray) -> np.ndarray:
    return (classes.astype(np.uint64) + np.uint64(1)) * _ODD


def _salted(contexts: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Contexts times the last factor of their slots' hash, which so is taken once a token, not once a bit."""
    return (((contexts ^ (contexts >> np.uint64(31))) * _STEP) ^ salts[:, None]) * _STEP


def _slots(contexts: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """The places in the tables of nodes at which a group of neighbours begins, by context; its other nodes' places differ from these in the lowest NEAR bits."""
    out = contexts + roots.view(np.uint64) * _NODE
    out >>= np.uint64(64 - SLOT_BITS)
    return out.view(np.int64)


def few_slots(classes: int) -> np.ndarray:
    """The slots of all nodes for the predictors that see no word before: by predictor, class and node."""
    of_class = _of_class(np.arange(classes))
    contexts = _salted(np.stack([np.zeros_like(of_class), of_class]), _SALTS[:FEW])
    node = np.arange(CELLS)
    depth = np.array([(n.bit_length() - 1) % NEAR if n >> NEAR else 0 for n in node.tolist()])
    near = node < 1 << NEAR
    offset = np.where(near, node, np.where(depth > 0, 1 << depth | node & ((1 << depth) - 1), 0))
    return _slots(contexts[:, :, None], np.where(near, 0, node >> depth)) ^ offset


def _bits(leaf: np.ndarray, known: np.ndarray, classes: np.ndarray, contexts: np.ndarray):
    """Bit by bit: its place, the tokens that have it, the bits, the nodes (0: whether the word is known; from 1: the bits of the cell that are known, behind a 1),
    the tokens' classes, and the slots of the predictors that see words before."""
    bit, root = known.astype(np.int64), np.zeros(len(known), np.int64)
    slots = _slots(contexts, root)
    yield 0, slice(None), bit, root, classes, slots
    at = np.flatnonzero(known)
    leaf, classes, contexts, root = leaf[at], classes[at], np.stack([c[at] for c in contexts]), np.stack([x[at] for x in slots])
    for b in range(CELL_BITS):
        node, depth = leaf >> (CELL_BITS - b), b % NEAR
        if b < NEAR:
            slots = root ^ node
        elif depth:
            slots = root ^ (1 << depth | node & ((1 << depth) - 1))
        else:
            slots = root = _slots(contexts, node)
        yield b + 1, at, (leaf >> (CELL_BITS - 1 - b)) & 1, node, classes, slots


def _with_bit(slots: np.ndarray, bit: np.ndarray) -> np.ndarray:
    out = slots << 1
    out |= bit
    return out


def _few_counts(tokens: Tokens) -> np.ndarray:
    """Zeros and ones at all nodes by class, from how many tokens have each cell."""
    classes = int(tokens.leaning.max(initial=0)) + 1
    at = np.where(tokens.known, cells(tokens.hashes) + 1, 0) + tokens.leaning.astype(np.int64) * (CELLS + 1)
    leaves = np.bincount(at, minlength=classes * (CELLS + 1)).reshape(classes, CELLS + 1)
    out = np.zeros((classes, CELLS, 2), np.int64)
    out[:, 0, 0], out[:, 0, 1] = leaves[:, 0], leaves[:, 1:].sum(axis=1)
    for b in range(CELL_BITS):
        out[:, 1 << b : 2 << b] = leaves[:, 1:].reshape(classes, 1 << b, 2, -1).sum(axis=3)
    return out


def count_bits(tokens: Tokens, out: np.ndarray | None = None) -> np.ndarray:
    """Zeros and ones in each slot of each predictor, over all tokens; added to ``out`` if given."""
    out, few = np.zeros((PREDICTORS, 2 * SLOTS), np.int32) if out is None else out, _few_counts(tokens)
    for k, slots in enumerate(few_slots(len(few))):
        np.add.at(out[k].reshape(SLOTS, 2), slots, few)
    for part in tokens.parts(_TOKENS):
        for _, _, bit, _, _, slots in _bits(*part):
            for total, own in zip(out[FEW:], _with_bit(slots, bit), strict=True):
                np.add.at(total, own, np.int32(1))
    return out


def predictions(counts: np.ndarray) -> np.ndarray:
    """Stretched predictions of a one by slot."""
    out = np.empty((PREDICTORS, SLOTS), np.float32)
    for own, n in zip(out, counts.reshape(PREDICTORS, SLOTS, 2), strict=True):
        np.log((n[:, 1] + np.float32(_PRIOR)) / (n[:, 0] + np.float32(_PRIOR)), out=own, casting="same_kind")
    return out


def without_own(counts: np.ndarray) -> np.ndarray:
    """The same by slot and bit, as they were without the one token that is being looked at, which had that bit."""
    out = np.empty((PREDICTORS, SLOTS, 2), np.float32)
    for own, n in zip(out, counts.reshape(PREDICTORS, SLOTS, 2), strict=True):
        less = np.maximum(n - 1, 0)
        own[:, 0] = np.log((n[:, 1] + np.float32(_PRIOR)) / (less[:, 0] + np.float32(_PRIOR)))
        own[:, 1] = np.log((less[:, 1] + np.float32(_PRIOR)) / (n[:, 0] + np.float32(_PRIOR)))
    return out.reshape(PREDICTORS, 2 * SLOTS)


class Mixer:
    """Weights by gate, and the map that refines, as sums of ones and of trials by gate and level."""

    def __init__(self, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.weights = np.full((GATES, PREDICTORS + 1), 0.3) if weights is None else weights
        self.refine = np.zeros((GATES, LEVELS, 2)) if refine is None else refine
        self.curvature = np.tile(np.eye(PREDICTORS + 1) * 20.0, (GATES, 1, 1))

    def train(self, tokens: Tokens, leave_out: np.ndarray) -> None:
        """One online pass: predict, see the bits, move the gate's weights by what it has seen of slope and curvature."""
        slots = few_slots(int(tokens.leaning.max(initial=0)) + 1)
        few = [leave_out[k].reshape(SLOTS, 2)[slots[k]].ravel() for k in range(FEW)]
        for part in tokens.parts(_TOKENS):
            for gate, _, bit, node, classes, slots in _bits(*part):
                x = np.ones((PREDICTORS + 1, len(bit)), np.float32)
                own = (classes * CELLS + node) * 2 + bit
                for k in range(FEW):
                    np.take(few[k], own, out=x[k], mode="clip")
                for k, own in enumerate(_with_bit(slots, bit), FEW):
                    np.take(leave_out[k], own, out=x[k], mode="clip")
                mixed = np.clip(self.weights[gate].astype(np.float32) @ x, -12, 12)
                p = squash(mixed)
                own = x * (p * (1 - p))
                self.curvature[gate] += np.stack([own @ row for row in x])
                self.weights[gate] += np.linalg.solve(self.curvature[gate], x @ (bit.astype(np.float32) - p))
                both = np.bincount(_level(mixed) * 2 + bit, minlength=2 * LEVELS).reshape(LEVELS, 2)
                self.refine[gate, :, 0] += both[:, 1]
                self.refine[gate, :, 1] += both.sum(axis=1)

    def log_probabilities(self, tokens: Tokens, table: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's bits; over all cells, and the word that isn't known, the probabilities sum to 1."""
        centre = squash(np.linspace(-8, 8, LEVELS))
        refined = np.log((self.refine[:, :, 0] + 2 * centre) / (self.refine[:, :, 1] - self.refine[:, :, 0] + 2 * (1 - centre))).astype(np.float32)
        weights, slots = self.weights.astype(np.float32), few_slots(int(tokens.leaning.max(initial=0)) + 1)
        gate_of = np.concatenate([[0], 1 + np.repeat(np.arange(CELL_BITS), 1 << np.arange(CELL_BITS))])
        few = (weights[gate_of, PREDICTORS] + sum(weights[gate_of, k] * table[k][slots[k]] for k in range(FEW))).ravel()
        out, done = np.empty(len(tokens.hashes)), 0
        for part in tokens.parts(_TOKENS):
            odds = np.ones(len(part[0]))  # the product of 1 / p over the bits, each less than 1e11
            of_known = np.ones(int(part[1].sum()))
            for gate, at, bit, node, classes, slots in _bits(*part):
                mixed = np.take(few, classes * CELLS + node, mode="clip")
                for k in range(FEW, PREDICTORS):
                    mixed += weights[gate, k] * np.take(table[k], slots[k - FEW], mode="clip")
                np.clip(mixed, -12, 12, out=mixed)
                mixed += np.take(refined[gate], _level(mixed), mode="clip")
                mixed *= np.float32(0.5) - bit.astype(np.float32)
                np.exp(mixed, out=mixed)
                mixed += 1
                if gate:
                    of_known *= mixed
                else:
                    odds *= mixed
            odds[at] *= of_known
            out[done : done + len(odds)] = -np.log(odds)
            done += len(odds)
        return out


def _level(mixed: np.ndarray) -> np.ndarray:
    return ((np.clip(mixed, -8, 8) + 8) * np.float32((LEVELS - 1) / 16) + np.float32(0.5)).astype(np.int64)
