"""Count tables of a fixed size, filled by all tasks and added up by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

_BLOCK = 1 << 16
#: Tables of so many tasks are added up first, then their sums: no group gathers all tasks.
_TASKS = 64
_ROWS = 8  # of a task's table that are handed over at once


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(raw: bytes, kind, width: int = 1) -> np.ndarray:
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(raw)), kind)
    return out.reshape(-1, width) if width > 1 else out


def _added(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(_BLOCK, np.int64)
    for x in rows["sums"]:
        total += expand(x, np.int32)
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "share": [rows["share"].iloc[0]], "sums": [squeeze(np.minimum(total, 2**31 - 1).astype(np.int32))]})


def summed(df: DataFrame, count: Callable[[pd.DataFrame, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all batches of what ``count`` adds to a table of ``size`` whole numbers, of which a task holds one; ``size`` bounds what a task holds and what the driver gets."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            total = np.zeros(size, np.int32) if total is None else total
            count(batch, total)
        if total is not None:
            blocks = total.reshape(-1, _BLOCK)
            for i in range(0, len(blocks), _ROWS):
                own = [squeeze(b) for b in blocks[i : i + _ROWS]]
                yield pd.DataFrame({"block": np.arange(i, i + len(own)), "share": TaskContext.get().partitionId() // _TASKS, "sums": own})

    out = np.zeros(size, np.int32)
    schema = "block long, share long, sums binary"
    shares = df.mapInPandas(of, schema).groupBy("block", "share").applyInPandas(_added, schema)
    for row in shares.groupBy("block").applyInPandas(_added, schema).collect():
        out.reshape(-1, _BLOCK)[row.block] = expand(row.sums, np.int32)
    return out
