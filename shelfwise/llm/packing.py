"""Packing into windows by the sum-of-squares rule.

Each partition packs its own documents as they stream by. Whole windows are cut off long documents; what is left of a
document goes to the fill level that makes the sum of squared counts of partly filled windows least (Csirik, Johnson,
Kenyon, Orlin, Shor and Weber's rule), which a level array tracks: adding s tokens to a window at level h changes the sum by
2 (N[h+s] - N[h] + 1), where level 0 is a new window and a full window counts for nothing.

A level array can't grow beyond the width, and windows that stay open are bounded by ``most_open``: beyond it, and at
the end of a partition, the emptiest open windows are cut up to fill the fullest ones, so that a partition leaves one
window at most; that one is cut into lengths that are powers of two, which need no padding.

Defined results: a null or empty text packs its end id alone; repeated rows are packed each for itself; an empty table
gives no piece; extra columns are not read. Sequence ids hold the partition's number, so a task that is run again gives
the same rows as long as its input comes in the same order (files do).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.shared import bound_batches, id_columns, ids
from shelfwise.llm.tokens import tokenizer

WIDTH = 2048
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class SumOfSquares:
    """Open windows by fill level; ``counts`` is the level array."""

    def __init__(self, width: int = WIDTH, most_open: int = 4096):
        self.width, self.most_open = width, most_open
        self.counts = np.zeros(width + 1)
        self.counts[width] = -0.5  # so that filling a window up costs 1 - 2 N[h]
        self.gain = np.full(width + 1, np.inf)  # -N[h] where a window is open, else never chosen
        self.gain[0] = -0.5  # so that a new window costs 2 N[s] + 1
        self.open: dict[int, list[list[Piece]]] = {}
        self.n_open = 0

    def _change(self, level: int, by: int) -> None:
        self.counts[level] += by
        self.gain[level] = -self.counts[level] if self.counts[level] else np.inf
        self.n_open += by

    def level(self, size: int) -> int:
        """Where the sum of squares grows least; of equal levels the fullest."""
        cost = (self.counts[size:] + self.gain[: self.width - size + 1])[::-1]
        return self.width - size - int(np.argmin(cost))

    def place(self, piece: Piece) -> Iterator[list[Piece]]:
        """Windows that this piece completes."""
        size = len(piece.ids)
        level = self.level(size)
        window = [piece]
        if level:
            window = self.open[level].pop()
            window.append(piece)
            self._change(level, -1)
        if level + size == self.width:
            yield window
            return
        self.open.setdefault(level + size, []).append(window)
        self._change(level + size, 1)
        if self.n_open > self.most_open:
            yield from self.merge()

    def merge(self) -> Iterator[list[Piece]]:
        """Fills the fullest open windows with what is cut off the emptiest ones; one stays open at most."""
        windows = [(level, w) for level in sorted(self.open) for w in self.open[level]]
        for level, _ in windows:
            self._change(level, -1)
        self.open.clear()
        low, high, loose = 0, len(windows) - 1, []
        while low < high or (low == high and loose):
            level, window = windows[high]
            high -= 1
            while level < self.width:
                if not loose:
                    if low > high:
                        break
                    loose = windows[low][1][::-1]
                    low += 1
                piece = loose.pop()
                if len(piece.ids) > self.width - level:
                    piece, rest = piece.cut(self.width - level)
                    loose.append(rest)
                window.append(piece)
                level += len(piece.ids)
            if level == self.width:
                yield window
            else:
                self._reopen(window)
        if low == high:
            self._reopen(windows[low][1])
        elif loose:
            self._reopen(loose[::-1])

    def _reopen(self, window: list[Piece]) -> None:
        level = sum(len(p.ids) for p in window)
        self.open.setdefault(level, []).append(window)
        self._change(level, 1)

    def close(self) -> Iterator[list[Piece]]:
        """All that is left: full windows and, of the last one, lengths that are powers of two."""
        yield from self.merge()
        loose = [p for windows in self.open.values() for w in windows for p in w][::-1]
        left = sum(len(p.ids) for p in loose)
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            window = []
            while want:
                piece = loose.pop()
                if len(piece.ids) > want:
                    piece, rest = piece.cut(want)
                    loose.append(rest)
                window.append(piece)
                want -= len(piece.ids)
            yield window


def pack_ids(docs: Iterator[tuple[object, np.ndarray]], width: int = WIDTH, most_open: int = 4096) -> Iterator[list[Piece]]:
    """Windows of pieces, for documents given as their ids."""
    packer = SumOfSquares(width, most_open)
    for doc, ids in docs:
        piece = Piece(doc, 0, ids, len(ids))
        while len(piece.ids) >= width:
            full, piece = piece.cut(width)
            yield [full]
        if len(piece.ids):
            yield from packer.place(piece)
    yield from packer.close()


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, split: str = "space-led", end: int = END, width: int = WIDTH, with_ids: bool = False) -> DataFrame:
    """A row of PIECES for each piece; ``with_ids`` adds the ids themselves as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(path, split)

        def stream():
            for batch in batches:
                texts = [t if isinstance(t, str) else None for t in batch["text"]]
                for doc, tokens in zip(ids(batch), encoder.encode(texts), strict=True):
                    yield doc, np.append(tokens, np.uint32(end)).astype("<u4")

        rows, number = [], TaskContext.get().partitionId() << 40
        for window in pack_ids(stream(), width):
            offset, full = 0, sum(len(p.ids) for p in window)
            for p in window:
                raw = p.ids.tobytes()
                rows.append((p.doc, p.start, len(p.ids), zlib.crc32(raw), p.total, number, offset, full, *[raw] * with_ids))
                offset += len(p.ids)
            number += 1
            if len(rows) >= 5000:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                rows = []
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    own = docs.select(*id_columns(docs[id_col]), docs[text_col].alias("text"))
    return own.mapInPandas(of, PIECES + ", ids binary" * with_ids)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
