"""Regressions within panels as DataFrame work: alternating demeaning by tables of effects, moment sums, small linear systems solved on columns,
and an ascent for many fits with very many effects at once.

Everything that is shuffled is a sum by key, combined before its shuffle; tables of effects meet the rows in an equi-join, which Spark
broadcasts where they are small. Tables that are read again are written to the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.staging import fewer_files, staged


def demean(df: DataFrame, columns: Sequence[str], groups: Sequence[Sequence[str]], weight: str | None = None, passes: int = 4) -> DataFrame:
    """``columns`` less their (weighted) means within each of two groups in turn, ``passes`` times over. ``df`` is read in each pass: a written table.

    What a pass takes off depends on the other group's effects alone, so only the two tables of effects change from pass to pass."""
    first, second = (list(g) for g in groups)
    w = F.col(weight) if weight else F.lit(1.0)

    def effects(by: list[str], name: str, others: DataFrame | None, on: list[str], other: str) -> DataFrame:
        rows, less = (df.join(others, on), lambda c: F.col(c) - F.col(f"{other}{c}")) if others is not None else (df, F.col)
        return rows.groupBy(*by).agg(*[(F.sum(w * less(c)) / F.sum(w)).alias(f"{name}{c}") for c in columns])

    b = None
    for _ in range(passes):
        a = effects(first, "__a_", b, second, "__b_")
        b = effects(second, "__b_", a, first, "__a_")
    out = df.join(a, first).join(b, second)
    return out.withColumns({c: F.col(c) - F.col(f"__a_{c}") - F.col(f"__b_{c}") for c in columns}).select(*df.columns)


def moments(x: Sequence[str], y: str, weight: str | None = None) -> list[Column]:
    """Aggregates g_i_j (i <= j) and h_i of the normal equations."""
    w = F.col(weight) if weight else F.lit(1.0)
    out = [F.sum(w * F.col(a) * F.col(b)).alias(f"g_{i}_{j}") for i, a in enumerate(x) for j, b in enumerate(x) if i <= j]
    return out + [F.sum(w * F.col(a) * F.col(y)).alias(f"h_{i}") for i, a in enumerate(x)]


def solve(df: DataFrame, n: int, names: Sequence[str]) -> DataFrame:
    """Solves the systems in columns g_i_j, h_i by elimination, all rows at once; columns that don't vary get 0."""
    cols = {f"a_{i}_{j}": F.col(f"g_{min(i, j)}_{max(i, j)}") for i in range(n) for j in range(n)} | {f"b_{i}": F.col(f"h_{i}") for i in range(n)}
    df = df.withColumns(cols).drop(*[f"g_{i}_{j}" for i in range(n) for j in range(i, n)], *[f"h_{i}" for i in range(n)])
    for k in range(n):
        pivot = F.when(F.abs(f"a_{k}_{k}") > 1e-12, F.col(f"a_{k}_{k}"))
        df = df.withColumns({f"f_{i}": F.coalesce(F.col(f"a_{i}_{k}") / pivot, F.lit(0.0)) for i in range(k + 1, n)})
        df = df.withColumns({f"a_{i}_{j}": F.col(f"a_{i}_{j}") - F.col(f"f_{i}") * F.col(f"a_{k}_{j}") for i in range(k + 1, n) for j in range(k, n)} | {f"b_{i}": F.col(f"b_{i}") - F.col(f"f_{i}") * F.col(f"b_{k}") for i in range(k + 1, n)})
    for k in reversed(range(n)):
        rest = sum((F.col(f"a_{k}_{j}") * F.col(names[j]) for j in range(k + 1, n)), F.lit(0.0))
        df = df.withColumn(names[k], F.when(F.abs(f"a_{k}_{k}") > 1e-12, (F.col(f"b_{k}") - rest) / F.col(f"a_{k}_{k}")).otherwise(0.0))
    return df.drop(*[f"a_{i}_{j}" for i in range(n) for j in range(n)], *[f"b_{i}" for i in range(n)], *[f"f_{i}" for i in range(n)])


#: A fit's place: parameters; the best ones before them with their value and the step that they ask for; earlier parameters and steps; losses in a row.
STATE = "theta array<double>, before array<double>, value double, step array<double>, places array<array<double>>, steps array<array<double>>, losses int, done boolean, converged boolean"

#: Earlier steps that a new one is put together from.
MEMORY = 6
#: Keys whose sums a task holds at a time, and shares of the tasks over which sums are added up first, so that no group has a row for each task.
HELD, SHARES = 256, 64
#: Numbers of rows and parameters (those of each line) up to which one task takes a key's lines through all rounds; longer keys go by rounds over all tasks.
AT_ONCE = 2_000_000

#: For one line of data (arrays of a store's rows) at parameters: value, gradient, and of the negative curvature its diagonal for all parameters but the
#: last ``dense``, their rows against the others (dense x others), and the last ones' own block.
Line = Callable[[object, np.ndarray], tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def packed(value: float, gradient: np.ndarray, diagonal: np.ndarray, cross: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.concatenate([[value], gradient, diagonal, cross.ravel(), own.ravel()])


def plain_step(gradient: np.ndarray, diagonal: np.ndarray, cross: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The solution for an arrowhead: the diagonal part is eliminated, the dense block (flat directions get 0) is solved."""
    n = len(diagonal)
    inverse = np.divide(1.0, diagonal, out=np.zeros(n), where=diagonal > 1e-12)
    last = np.linalg.lstsq(own - (cross * inverse) @ cross.T, gradient[n:] - cross @ (inverse * gradient[:n]), rcond=1e-12)[0]
    return np.concatenate([inverse * (gradient[:n] - last @ cross), last])


def joined_step(places: list[np.ndarray], steps: list[np.ndarray]) -> np.ndarray:
    """From the last place, the step that makes the next one's smallest if steps change linearly between places (Anderson's mixing)."""
    if len(steps) < 2:
        return steps[-1]
    moved, changed = np.diff(places, axis=0).T, np.diff(steps, axis=0).T
    share = np.linalg.lstsq(changed, steps[-1], rcond=1e-10)[0]
    return steps[-1] - (moved + changed) @ share


def advanced(first: dict, total: np.ndarray, dense: int, tolerance: float) -> dict:
    """A key's next place. A place that lost value is left for a shorter plain step from the best one."""
    theta, before = np.asarray(first["theta"], np.float64), np.asarray(first["before"], np.float64)
    n = len(theta) - dense
    value, gradient, diagonal, cross, own = total[0], total[1 : 1 + n + dense], total[1 + n + dense : 1 + 2 * n + dense], total[1 + 2 * n + dense : 1 + 2 * n + dense + n * dense].reshape(dense, n), total[len(total) - dense * dense :].reshape(dense, dense)
    if not np.isfinite(total).all() or value < first["value"] - 1e-10 * max(1.0, abs(first["value"])):
        step, losses = np.asarray(first["step"], np.float64), first["losses"] + 1
        stuck = not np.isfinite(first["value"]) or losses > 40
        return first | {"theta": before + step / 2 ** (losses - 1), "places": [], "steps": [], "losses": losses, "done": stuck}
    step = plain_step(gradient, diagonal, cross, own)
    done = bool(np.abs(step).max(initial=0) < tolerance)
    places, steps = ([*(np.asarray(x, np.float64) for x in first[c]), new][-MEMORY:] for c, new in (("places", theta), ("steps", step)))
    return first | {
        "theta": theta + (step if done or not n else joined_step(places, steps)), "before": theta, "value": value, "step": step, "places": places, "steps": steps, "losses": 0, "done": done, "converged": done,
    }


def maximise(lines: DataFrame, start: DataFrame, keys: Sequence[str], line: Line, dense: int, tolerance: float = 1e-9, most: int = 200, at_once: int = AT_ONCE) -> DataFrame:
    """(keys, theta, converged) that maximise the sum of ``line`` over each key's lines (with their rows in arrays, ``units`` one of them), from ``start`` (keys, theta).

    A key whose lines and parameters are at most ``at_once`` numbers is taken to its end by one task, so that it costs one job and not one a round. For longer
    keys, each round adds gradient and curvature up by key: within tasks, over shares of the tasks, then over shares. Only the last ``dense``
    parameters have whole rows of curvature; of the others (one for each week, say) only the diagonal is kept, so a row of sums is a few
    times as long as the parameters, and what the diagonal leaves out is learnt from the last MEMORY steps. A key is done when no
    parameter's plain step reaches ``tolerance``; keys that are done are left out of the next round, and only whether any is left comes to the driver."""
    names = list(keys)
    types = ", ".join(f"{c} {t}" for c, t in lines.select(*names).dtypes)

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        share = TaskContext.get().partitionId() % SHARES

        def told():
            return pd.DataFrame([[*key, share, total] for key, total in totals.items()], columns=[*names, "share", "sums"])

        for batch in batches:
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, c) for c in names)
                with np.errstate(all="ignore"):
                    own = packed(*line(row, np.asarray(row.theta, np.float64)))
                if key in totals:
                    totals[key] += own
                else:
                    if len(totals) >= HELD:
                        yield told()
                        totals = {}
                    totals[key] = own
        if totals:
            yield told()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        return pd.DataFrame([[*[first[c] for c in names], first["share"], np.sum(rows["sums"].tolist(), axis=0)]], columns=[*names, "share", "sums"])

    columns = [c.split()[0] for c in STATE.split(", ")]

    def stepped(rows: pd.DataFrame) -> pd.DataFrame:
        first = {c: rows[c].iloc[0] for c in [*names, *columns]}
        new = advanced(first, np.sum(rows["sums"].tolist(), axis=0), dense, tolerance)
        return pd.DataFrame([[new[c] for c in [*names, *columns]]], columns=[*names, *columns])

    none = F.array().cast("array<array<double>>")
    state = start.select(
        *names, "theta", F.col("theta").alias("before"), F.lit(float("-inf")).alias("value"), F.transform("theta", lambda x: F.lit(0.0)).alias("step"), none.alias("places"), none.alias("steps"), F.lit(0).alias("losses"),
        F.lit(False).alias("done"), F.lit(False).alias("converged"),
    )
    state = staged(fewer_files(state), "fits")
    lengths = lines.groupBy(*names).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.size("units")).alias("numbers"))
    long = F.col("numbers") + F.col("lines") * F.size("theta") > at_once
    lengths = staged(fewer_files(state.join(lengths, names).select(*names, long.alias("long"))), "lengths")

    def ended(rows: pd.DataFrame) -> pd.DataFrame:
        first, n = {c: rows[c].iloc[0] for c in [*names, *columns]}, 0
        own = list(rows.itertuples(index=False))
        while n < most and not first["done"]:
            with np.errstate(all="ignore"):
                total = sum(packed(*line(row, np.asarray(first["theta"], np.float64))) for row in own)
            first, n = advanced(first, total, dense, tolerance), n + 1
        return pd.DataFrame([[*[first[c] for c in names], first["theta"], first["converged"]]], columns=[*names, "theta", "converged"])

    short = lines.join(state.join(lengths.where("not long").drop("long"), names), names)
    finished = staged(fewer_files(short.groupBy(*names).applyInPandas(ended, f"{types}, theta array<double>, converged boolean")), "fits")
    state = state.join(lengths.where("long").drop("long"), names)
    if state.isEmpty():
        return finished
    sums = f"{types}, share int, sums array<double>"
    for n in range(most):
        shares = lines.join(state.select(*names, "theta"), names).mapInPandas(parts, sums).groupBy(*names, "share").applyInPandas(added, sums)
        new = staged(fewer_files(shares.join(state, names).groupBy(*names).applyInPandas(stepped, f"{types}, {STATE}")), "fits")
        own = new.where("done") if n < most - 1 else new
        finished = finished.unionByName(own.select(*finished.columns))
        state = new.where("not done")
        if state.isEmpty():
            break
    return finished
