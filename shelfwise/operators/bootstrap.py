"""Percentile bootstrap of a weighted share, with Poisson resampling.

Each row gets a Poisson(1) count in each replicate: the hash of its key times the replicate's odd multiplier, whose low bits are a uniform
number. So replicates need no order and no driver loop, and give the same result however the rows are partitioned. A row is hashed once and never
multiplied: tasks add up a vector of all replicates by group, and only such vectors are shuffled. Intervals agree with resampling rows
statistically, not digit by digit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cumulative probabilities of a Poisson(1) count of 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020)
#: Bits of a hash, rows at a time, groups that a task holds, and shares of the tasks over which vectors are added up first.
_BITS, _ROWS, _HELD, _SHARES = 52, 512, 256, 64


def multipliers(replicates: int, seed: int) -> np.ndarray:
    """Odd, and otherwise the first 52 bits of an MD5 of seed and replicate."""
    return np.array([int(hashlib.md5(f"{seed}|{b}".encode()).hexdigest()[:13], 16) | 1 for b in range(1, replicates + 1)], np.uint64)


def resampled(hashes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Counts, a row for each hash and a column for each multiplier."""
    u = ((hashes[:, None] * by[None, :]) & np.uint64((1 << _BITS) - 1)) / float(1 << _BITS)
    return np.searchsorted(POISSON, u, side="right")


def fraction_interval(rows: DataFrame, keys: Sequence[str], row_key: Sequence[str], indicator: str, weight: str | None = None, replicates: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(keys, ci_low, ci_high, n_boot); no rows where there is nothing to resample or ``replicates`` is 0."""
    keys = list(keys)
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in row_key], F.lit(str(seed)))
    hashed = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = rows.select(*keys, F.col(indicator).cast("double").alias("__x"), w.alias("__w"), hashed.alias("__h")).where(F.lit(replicates > 0))
    types = ", ".join(f"`{c}` {t}" for c, t in each.select(*keys).dtypes)
    named = [*keys, "__share", "__sums"]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by, share, totals = multipliers(replicates, seed), TaskContext.get().partitionId() % _SHARES, {}

        def told():
            return pd.DataFrame([[*key, share, total.ravel()] for key, total in totals.items()], columns=named)

        for batch in batches:
            for key, group in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(k) else k for k in key)
                if key not in totals and len(totals) >= _HELD:
                    yield told()
                    totals = {}
                total = totals.setdefault(key, np.zeros((2, replicates)))
                w, x = group["__w"].fillna(0.0).to_numpy(), group["__x"].fillna(0.0).to_numpy()
                h = group["__h"].to_numpy().astype(np.uint64)
                for at in range(0, len(h), _ROWS):
                    here = slice(at, at + _ROWS)
                    total += np.stack([w[here] * x[here], w[here]]) @ resampled(h[here], by)
        if totals:
            yield told()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame([[*[first[c] for c in keys], first["__share"], np.sum(rows["__sums"].tolist(), axis=0)]], columns=named)

    def interval(rows: pd.DataFrame) -> pd.DataFrame:
        top, under = np.sum(rows["__sums"].tolist(), axis=0).reshape(2, -1)
        drawn = under != 0
        if not drawn.any():
            return pd.DataFrame(columns=[*keys, "ci_low", "ci_high"])
        low, high = np.quantile(top[drawn] / under[drawn], [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([[*[rows[c].iloc[0] for c in keys], low, high]], columns=[*keys, "ci_low", "ci_high"])

    sums = f"{types}, __share int, __sums array<double>"
    shares = each.mapInPandas(parts, sums).groupBy(*keys, "__share").applyInPandas(added, sums)
    return shares.groupBy(*keys).applyInPandas(interval, f"{types}, ci_low double, ci_high double").withColumn("n_boot", F.lit(replicates))
