"""Log-log demand: Poisson price response with store and week effects, instrumented or not, and seasonal calibration around it.

Re-aimed from per-product dummy regressions on samples: all products of all cells in one job, on all rows. Store effects are concentrated out in
closed form, week effects are parameters, and an ascent with a curvature that is diagonal over weeks runs on sums over stores, so results agree with the
dummy form to the tolerance and nothing that is shuffled has the square of the number of weeks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import bounded_exp, log_price, season
from shelfwise.operators.elasticity import AFFECTED, PRICED, product_grid
from shelfwise.operators.panel_fit import maximise
from shelfwise.staging import fewer_files, staged

CELL = ("cell_slug",)
LEAST_OFFSET_UNITS, LEAST_ROWS = 0.05, 50
SEASON = ("season_sin1", "season_cos1", "season_sin2", "season_cos2")


def neighbour_index(frame: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL, legs: Sequence[str] = ()) -> DataFrame:
    """``frame`` with ``npi``: the weighted mean log price of the neighbours in the same store-week.

    A neighbour without a price there counts with its mean over the frame (of each leg), else 0; a product without neighbours has 0.
    The frame is shuffled once, into a row for each store-week with its products and their prices, in which each product looks its neighbours up;
    neighbours with their usual prices are a table by product, which Spark broadcasts where it is small."""
    keys, place = [*cell, *legs], [*cell, *legs, "store_id", "week"]
    each = frame.select(*place, F.struct("*", log_price("price").alias("__lp")).alias("row")).groupBy(*place).agg(F.collect_list("row").alias("rows"))
    # of several rows of a product, the mean
    named = F.array_distinct(F.filter("rows.product_id", lambda p: p.isNotNull()))
    there = each.withColumn("prices", F.transform(named, lambda p: F.struct(p.alias(PRICED), _mean_of(F.filter("rows", lambda r: r["product_id"] == p)).alias("lp"))))
    there = staged(there.select(*keys, "rows", "prices"), "store-weeks")
    usual = there.select(*keys, F.explode("prices").alias("p")).groupBy(*keys, f"p.{PRICED}").agg(F.avg("p.lp").alias("usual"))
    # a neighbour that the frame hasn't at all counts as 0, so only those that it has are kept
    known = weights.join(usual, [*cell, PRICED]).groupBy(*keys, F.col(AFFECTED).alias("__of")).agg(F.collect_list(F.struct(F.col(PRICED).alias("id"), "w", "usual")).alias("near"))
    opened = there.select(*keys, F.explode("rows").alias("row"), F.map_from_entries("prices").alias("prices")).withColumn("__of", F.col("row.product_id"))
    index = F.aggregate("near", F.lit(0.0), lambda total, n: total + n["w"] * F.coalesce(F.try_element_at("prices", n["id"]), n["usual"], F.lit(0.0)))
    return opened.join(known, [*keys, "__of"], "left").select(*[F.col("row").getField(c).alias(c) for c in frame.columns], F.coalesce(index, F.lit(0.0)).alias("npi"))


def _mean_of(rows: Column) -> Column:
    """Of the rows' log prices; null if none has one."""
    known = F.filter(F.transform(rows, lambda r: r["__lp"]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def prepared(training: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Training rows with log price and neighbour index."""
    return neighbour_index(training.withColumn("log_price", log_price("price")), weights, cell)


def store_levels(rows: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, product_id, store_id, offset, p_bar, npi_bar): log of the mean units, and means of log price and index."""
    return rows.groupBy(*cell, "product_id", "store_id").agg(F.log(F.greatest(F.avg("units"), F.lit(LEAST_OFFSET_UNITS))).alias("offset"), F.avg("log_price").alias("p_bar"), F.avg("npi").alias("npi_bar"))


def store_lines(rows: DataFrame, cell: Sequence[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """(a line for each product and store with sales: arrays of its rows, ``at`` being the week's place; (cell, product_id, theta): logs of the weeks' units).

    Weeks without units of the product are separated and leave. A line is as long as the weeks of a panel."""
    keys = [*cell, "product_id"]
    weeks = rows.groupBy(*keys, "week").agg(F.sum("units").alias("u")).where("u > 0").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("week", F.log("u").alias("log_units")))).alias("weeks"))
    cost = F.col("supply_cost_proxy").cast("double") if "supply_cost_proxy" in rows.columns else F.lit(None).cast("double")
    each = rows.groupBy(*keys, "store_id").agg(F.sum("units").alias("total"), F.collect_list(F.struct("week", F.col("units").cast("double").alias("units"), "log_price", F.col("npi").cast("double").alias("npi"), cost.alias("cost"))).alias("rows")).where("total > 0")
    place = F.transform("rows", lambda r: F.struct((F.array_position("weeks.week", r["week"]) - 1).cast("int").alias("at"), r["units"].alias("units"), r["log_price"].alias("log_price"), r["npi"].alias("npi"), r["cost"].alias("cost")))
    lines = each.join(weeks, keys).withColumn("rows", F.filter(place, lambda r: r["at"] >= 0)).select(*keys, "store_id", *[F.col(f"rows.{c}").alias(c) for c in ("at", "units", "log_price", "npi", "cost")])
    return lines, weeks.select(*keys, F.col("weeks.log_units").alias("theta"))


def _design(row, x: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.asarray(row.at, np.int64), np.asarray(row.units, np.float64), np.array([np.asarray(getattr(row, c), np.float64) for c in x]).reshape(len(x), -1)


def _arrowhead(at: np.ndarray, z: np.ndarray, weight: np.ndarray, weeks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted curvature of a store's rows, its own effect taken out of the rows of ``z``: diagonal over weeks, ``z`` against weeks, and ``z``'s block.

    Weeks meet each other only through the stores' effects; that part (one rank a store) is left out, so the diagonal bounds the block from above."""
    total, each = weight.sum(), np.bincount(at, weight, weeks)
    mean = z @ weight / total if total > 0 else np.zeros(len(z))
    away = z - mean[:, None]
    cross = np.array([np.bincount(at, weight * own, weeks) for own in away]).reshape(len(z), weeks)
    return each, cross, (away * weight) @ away.T


def poisson_line(x: Sequence[str]):
    """Log-likelihood of a store's weeks given its total."""

    def of(row, theta: np.ndarray):
        at, y, z = _design(row, x)
        weeks = len(theta) - len(x)
        eta = theta[:weeks][at] + theta[weeks:] @ z
        eta -= eta.max(initial=-np.inf)
        e = np.exp(eta)
        mu = y.sum() * e / e.sum()
        return float(y @ (eta - np.log(e.sum()))), np.concatenate([np.bincount(at, y - mu, weeks), z @ (y - mu)]), *_arrowhead(at, z, mu, weeks)

    return of


def _costs(row) -> np.ndarray:
    """The store's costs; where one is missing, the mean of the others."""
    cost = np.array([np.nan if c is None else c for c in row.cost], np.float64)
    return np.where(np.isnan(cost), np.nanmean(cost) if (~np.isnan(cost)).any() else 0.0, cost)


def cost_line(row, theta: np.ndarray):
    """Least squares of the log price on the cost: the residual's projections on weeks and on the cost, the store's mean taken out."""
    at, _, p = _design(row, ["log_price"])
    z = _costs(row)[None, :]
    left = p[0] - theta[:-1][at] - theta[-1] * z[0]
    left -= left.mean()
    return float(-(left @ left) / 2), np.concatenate([np.bincount(at, left, len(theta) - 1), z @ left]), *_arrowhead(at, z, np.ones(len(at)), len(theta) - 1)


def control_function(lines: DataFrame, start: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """``lines`` with ``cf_residual``, what store and week effects and the cost instrument leave of the log price, and ``slope``, the cost's coefficient."""
    keys = [*cell, "product_id"]
    zeros = F.array_repeat(F.lit(0.0), F.size("theta") + 1)
    fitted = maximise(lines, start.select(*keys, zeros.alias("theta")), keys, cost_line, 1)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                theta = np.asarray(row.theta)
                left = np.asarray(row.log_price) - theta[:-1][np.asarray(row.at, np.int64)] - theta[-1] * _costs(row)
                out.append(left - left.mean())
            yield batch.drop(columns="theta").assign(cf_residual=out, slope=[float(t[-1]) for t in batch["theta"]])

    schema = ", ".join(f"{c} {t}" for c, t in lines.dtypes) + ", cf_residual array<double>, slope double"
    return lines.join(fitted.select(*keys, "theta"), keys).select(*lines.columns, "theta").mapInPandas(of, schema)


def price_response(rows: DataFrame, use_iv: bool, cell: Sequence[str] = CELL, iterations: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(cell, product_id, beta, gamma, converged) of the Poisson fit with store and week effects."""
    keys = [*cell, "product_id"]
    lines, start = store_lines(rows, cell)
    lines, start, x = staged(fewer_files(lines), "lines"), staged(fewer_files(start), "weeks"), ["log_price", "npi"]
    if use_iv:
        lines, x = staged(control_function(lines, start, cell), "lines"), [*x, "cf_residual"]
    start = start.select(*keys, F.concat("theta", F.array(*[F.lit(0.0) for _ in x])).alias("theta"))
    found = maximise(lines, start, keys, poisson_line(x), len(x), tolerance, iterations)
    at = lambda k: F.when(F.col("converged"), F.element_at("theta", k - len(x))).otherwise(0.0)
    return found.select(*keys, at(0).alias("beta"), at(1).alias("gamma"), "converged")


def season_line(row, theta: np.ndarray):
    """Log-likelihood of a store's rows by level and harmonics around the fixed part."""
    y, fixed = np.asarray(row.units, np.float64), np.asarray(row.fixed, np.float64)
    x = np.array([np.ones(len(y)), *[np.asarray(getattr(row, c), np.float64) for c in SEASON]])
    eta = np.clip(fixed + theta @ x, -30, 30)
    mu = np.exp(eta)
    return float(y @ eta - mu.sum()), x @ (y - mu), np.empty(0), np.empty((len(x), 0)), (x * mu) @ x.T


def calibration(rows: DataFrame, response: DataFrame, levels: DataFrame, cell: Sequence[str] = CELL, iterations: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(cell, product_id, const, season...) of the Poisson fit of level and harmonics around the fixed price response; zeros where it doesn't converge."""
    keys = [*cell, "product_id"]
    joined = rows.join(response.select(*keys, "beta", "gamma"), keys).join(levels, [*keys, "store_id"])
    fixed = F.col("offset") + F.col("beta") * (F.col("log_price") - F.col("p_bar")) + F.col("gamma") * (F.col("npi") - F.col("npi_bar"))
    each = joined.groupBy(*keys, "store_id").agg(F.collect_list(F.struct(F.col("units").cast("double").alias("units"), fixed.alias("fixed"), *[c.alias(n) for n, c in season("week").items()])).alias("rows"))
    lines = staged(fewer_files(each.select(*keys, *[F.col(f"rows.{c}").alias(c) for c in ("units", "fixed", *SEASON)])), "lines")
    x = ["const", *SEASON]
    start = lines.select(*keys).distinct().withColumn("theta", F.array(*[F.lit(0.0) for _ in x]))
    found = maximise(lines, start, keys, season_line, len(x), tolerance, iterations)
    return found.select(*keys, *[F.when(F.col("converged"), F.col("theta")[k]).otherwise(0.0).alias(n) for k, n in enumerate(x)])


def fit(training: DataFrame, weights: DataFrame, use_iv: bool, cell: Sequence[str] = CELL, iterations: int = 200) -> tuple[DataFrame, DataFrame]:
    """(coefficients, store levels). Products without units, with fewer than LEAST_ROWS rows in stores with sales, or whose fit fails get zeros."""
    keys = [*cell, "product_id"]
    rows = staged(fewer_files(prepared(training, weights, cell)), "prepared")
    levels = store_levels(rows, cell)
    stores = rows.groupBy(*keys, "store_id").agg(F.sum("units").alias("u"), F.count(F.lit(1)).alias("n"))
    enough = stores.groupBy(*keys).agg((F.sum("u") > 0).alias("sold"), F.coalesce(F.sum(F.when(F.col("u") > 0, F.col("n"))), F.lit(0)).alias("n"))
    fitted = rows.join(enough.where((F.col("n") >= LEAST_ROWS) & F.col("sold")), keys, "left_semi")
    response = staged(price_response(fitted, use_iv, cell, iterations), "response")
    every = response.join(calibration(fitted, response, levels, cell), keys, "left")
    zeros = {n: 0.0 for n in ("beta", "gamma", "const", *SEASON)}
    out = enough.select(*keys).join(every, keys, "left").fillna(zeros).withColumn("converged", F.coalesce("converged", F.lit(False)))
    return out, levels


def predict_mean(frame: DataFrame, coefficients: DataFrame, levels: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL, legs: Sequence[str] = ()) -> DataFrame:
    """``frame`` with ``predicted_units``. Unknown pairs take the cell's median offset and their own price and index as means; unknown products get 0."""
    rows = neighbour_index(frame.withColumn("log_price", log_price("price")), weights, cell, legs)
    usual = levels.groupBy(*cell).agg(F.median("offset").alias("usual"))
    rows = rows.join(levels, [*cell, "product_id", "store_id"], "left").join(usual, list(cell), "left").join(coefficients, [*cell, "product_id"], "left")
    linear = F.col("const") + F.coalesce("offset", "usual") + F.col("beta") * (F.col("log_price") - F.coalesce("p_bar", "log_price")) + F.col("gamma") * (F.col("npi") - F.coalesce("npi_bar", "npi"))
    linear = linear + sum((F.col(n) * c for n, c in season("week").items()), F.lit(0.0))
    return rows.select(*frame.columns, F.coalesce(bounded_exp(linear), F.lit(0.0)).alias("predicted_units"))


def elasticities(coefficients: DataFrame, weights: DataFrame, products: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Own: beta. Cross: gamma times the neighbour's weight."""
    grid = product_grid(products, cell).join(weights, [*cell, AFFECTED, PRICED], "left").join(coefficients.select(*cell, F.col("product_id").alias(AFFECTED), "beta", "gamma"), [*cell, AFFECTED], "left")
    value = F.when(F.col(AFFECTED) == F.col(PRICED), F.coalesce("beta", F.lit(0.0))).otherwise(F.coalesce("gamma", F.lit(0.0)) * F.coalesce("w", F.lit(0.0)))
    return grid.select(*cell, AFFECTED, PRICED, value.alias("elasticity"))


def sweep_deltas(sweep: DataFrame, coefficients: DataFrame, levels: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Predicted change of units of each sweep row: both legs of all scenarios in one pass."""
    legs = F.explode(F.array(F.struct(F.lit(0).alias("leg"), F.col("baseline_price").alias("price")), F.struct(F.lit(1).alias("leg"), F.col("intervention_price").alias("price")))).alias("l")
    both = sweep.select(*cell, "intervention_id", "product_id", "store_id", "week", legs).select(*cell, "intervention_id", "product_id", "store_id", "week", "l.leg", "l.price")
    mean = predict_mean(both, coefficients, levels, weights, cell, ("intervention_id", "leg"))
    sign = F.when(F.col("leg") == 1, F.col("predicted_units")).otherwise(-F.col("predicted_units"))
    return mean.groupBy(*cell, "intervention_id", "product_id", "store_id", "week").agg(F.sum(sign).alias("predicted_delta_units"))
