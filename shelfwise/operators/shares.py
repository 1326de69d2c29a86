"""Share-space discrete choice: price slopes of log shares, incidence, market size, and logit shares with expected diversion.

Re-aimed: shares at new prices follow the logit in closed form around observed store shares instead of simulated probit draws, and the price scale
matches the same share-weighted target under the logit. Shapes, signs, share sums, diversion and incidence are the same; probit numbers are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import phase
from shelfwise.operators.elasticity import AFFECTED, PRICED, product_grid
from shelfwise.operators.panel_fit import demean, moments, solve
from shelfwise.staging import fewer_files, staged

CELL = ("cell_slug",)
LEAST_SHARE, FLOOR_SHARE, PASSES, LEAST_ROWS, SMALL_ASSORTMENT, MIX, ARC = 1e-6, 1e-4, 4, 200, 10, 0.5, 0.10


def share_panel(training: DataFrame, clipped: bool, cell: Sequence[str] = CELL) -> DataFrame:
    """Rows with log share in the store-week and weight: units of rows with sales, or 1 for all rows if ``clipped``."""
    total = training.groupBy(*cell, "store_id", "week").agg(F.sum("units").alias("total"))
    rows = training.join(total, [*cell, "store_id", "week"]).where("total > 0" if clipped else "total > 0 and units > 0")
    share = F.greatest(F.col("units") / F.col("total"), F.lit(LEAST_SHARE))
    return rows.select(*cell, "product_id", "store_id", "week", F.log(share).alias("log_share"), F.col("price").cast("double").alias("price"), F.col("supply_cost_proxy").cast("double").alias("supply_cost_proxy"), (F.lit(1.0) if clipped else F.col("units").cast("double")).alias("wt"))


def demeaned_shares(panel: DataFrame, cell: Sequence[str] = CELL, passes: int = PASSES) -> DataFrame:
    """Within (product, store) and week, in turn, exactly ``passes`` times."""
    return demean(staged(fewer_files(panel), "shares"), ["log_share", "price", "supply_cost_proxy"], [[*cell, "product_id", "store_id"], [*cell, "week"]], "wt", passes)


def slope(use_iv: bool) -> Column:
    """Aggregate: weighted OLS slope of the log share on price, or its IV slope by cost; null where it isn't identified."""
    w, x, y, z = (F.col(c) for c in ("wt", "price", "log_share", "supply_cost_proxy"))
    if use_iv:
        den = F.sum(w * z * x)
        return F.when(F.abs(den) > 1e-9, F.sum(w * z * y) / den)
    den = F.sum(w * x * x)
    return F.when(den > 1e-9, F.sum(w * x * y) / den)


def price_slopes(training: DataFrame, use_iv: bool, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, product_id, target): the product's own slope if it has LEAST_ROWS rows and is negative, else the pooled one.

    Cells with few products have the pooled slope of the clipped panel throughout."""
    each = training.select(*cell, "product_id").distinct()
    small = each.groupBy(*cell).agg((F.count(F.lit(1)) < SMALL_ASSORTMENT).alias("small"))
    by_sales = staged(demeaned_shares(share_panel(training, False, cell), cell), "demeaned")
    clipped = demeaned_shares(share_panel(training.join(small.where("small"), list(cell), "left_semi"), True, cell), cell)
    pooled = by_sales.groupBy(*cell).agg(slope(use_iv).alias("pooled")).join(clipped.groupBy(*cell).agg(slope(use_iv).alias("clipped")), list(cell), "left").join(small, list(cell))
    own = by_sales.groupBy(*cell, "product_id").agg(slope(use_iv).alias("own"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST_ROWS) & (F.col("own") < 0))
    target = F.when(F.col("small"), F.coalesce("clipped", F.lit(0.0))).otherwise(F.coalesce("own", "pooled", F.lit(0.0)))
    return each.join(pooled, list(cell)).join(own, [*cell, "product_id"], "left").select(*cell, "product_id", target.alias("target"))


def store_shares(training: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, store_id, product_id, share) of units over all weeks, zeros included; stores without units leave."""
    units = training.groupBy(*cell, "store_id", "product_id").agg(F.sum("units").alias("u"))
    total = units.groupBy(*cell, "store_id").agg(F.sum("u").alias("total")).where("total > 0")
    grid = total.join(training.select(*cell, "product_id").distinct(), list(cell))
    return grid.join(units, [*cell, "store_id", "product_id"], "left").select(*cell, "store_id", "product_id", (F.coalesce("u", F.lit(0.0)) / F.col("total")).alias("share"))


def store_prices(training: DataFrame, grid: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, store_id, product_id, mean_price): the store's mean, else the product's mean over stores, else the mean of products' means."""
    own = training.groupBy(*cell, "store_id", "product_id").agg(F.avg("price").alias("own"))
    across = own.groupBy(*cell, "product_id").agg(F.avg("own").alias("across"))
    overall = training.groupBy(*cell, "product_id").agg(F.avg("price").alias("p")).groupBy(*cell).agg(F.avg("p").alias("overall"))
    out = grid.select(*cell, "store_id", "product_id").join(own, [*cell, "store_id", "product_id"], "left").join(across, [*cell, "product_id"], "left").join(overall, list(cell), "left")
    return out.select(*cell, "store_id", "product_id", F.coalesce("own", "across", "overall").alias("mean_price"))


def price_scale(shares: DataFrame, targets: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, scale): utility per price that matches the share-weighted targets under the logit, within [4 min(mean target, 0), 0]."""
    each = shares.groupBy(*cell, "product_id").agg(F.avg("share").alias("w"), F.avg(1 - F.col("share")).alias("room")).join(targets, [*cell, "product_id"])
    out = each.groupBy(*cell).agg(F.sum(F.col("w") * F.col("target")).alias("num"), F.sum(F.col("w") * F.col("room")).alias("den"), (F.sum(F.greatest("w", F.lit(1e-9)) * F.col("target")) / F.sum(F.greatest("w", F.lit(1e-9)))).alias("mean"))
    return out.select(*cell, F.when(F.col("den") > 1e-9, F.least(F.greatest(F.col("num") / F.col("den"), 4 * F.least("mean", F.lit(0.0))), F.lit(0.0))).alias("scale"))


def incidence(training: DataFrame, cell: Sequence[str] = CELL, passes: int = PASSES) -> DataFrame:
    """(cell, slope) of the store-week's log volume on its unit-weighted price index, within stores and weeks."""
    units = training.groupBy(*cell, "product_id").agg(F.sum("units").alias("u"))
    w = units.select(*cell, "product_id", (F.col("u") / F.greatest(F.sum("u").over(Window.partitionBy(*cell)), F.lit(1.0))).alias("w"))
    weeks = training.join(w, [*cell, "product_id"]).groupBy(*cell, "store_id", "week").agg(F.sum("units").alias("m"), (F.sum(F.col("w") * F.col("price")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("p_bar"))
    flat = demean(staged(fewer_files(weeks.where("m > 0").withColumn("log_m", F.log("m"))), "volumes"), ["log_m", "p_bar"], [[*cell, "store_id"], [*cell, "week"]], passes=passes)
    den = F.sum(F.col("p_bar") * F.col("p_bar"))
    return flat.groupBy(*cell).agg(F.when(den > 1e-9, F.sum(F.col("p_bar") * F.col("log_m")) / den).otherwise(0.0).alias("slope"))


def rho(slopes: DataFrame, scales: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, rho): incidence passed through per unit of utility, in [0, 1.5]; 0 without a price response."""
    value = F.when(F.col("scale") >= -1e-9, 0.0).otherwise(F.least(F.greatest(F.col("slope") / F.col("scale"), F.lit(0.0)), F.lit(1.5)))
    return slopes.join(scales, list(cell)).select(*cell, F.coalesce(value, F.lit(0.0)).alias("rho"))


def market_levels(training: DataFrame, cell: Sequence[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """((cell, store_id, level), (cell, c0, c1, c2)): mean volume of each store and the season of volumes relative to it."""
    weeks = training.groupBy(*cell, "store_id", "week").agg(F.sum("units").alias("m"))
    levels = weeks.groupBy(*cell, "store_id").agg(F.avg("m").alias("level"))
    x = weeks.join(levels, [*cell, "store_id"]).select(*cell, F.lit(1.0).alias("one"), F.sin(phase("week")).alias("s"), F.cos(phase("week")).alias("c"), (F.col("m") / F.col("level")).alias("rel")).where("rel is not null")
    return levels, solve(x.groupBy(*cell).agg(*moments(["one", "s", "c"], "rel")), 3, ["c0", "c1", "c2"])


def market_size(store_weeks: DataFrame, levels: DataFrame, seasons: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """``store_weeks`` with ``market``: level (the median for unknown stores) times the season, which is 0.05 at least."""
    usual = levels.groupBy(*cell).agg(F.median("level").alias("usual"))
    rows = store_weeks.join(levels, [*cell, "store_id"], "left").join(usual, list(cell), "left").join(seasons, list(cell), "left")
    rel = F.col("c0") + F.col("c1") * F.sin(phase("week")) + F.col("c2") * F.cos(phase("week"))
    return rows.select(*store_weeks.columns, (F.coalesce("level", "usual") * F.greatest(rel, F.lit(0.05))).alias("market"))


def shares_at(rows: DataFrame, by: Sequence[str], price: str, out: str) -> DataFrame:
    """Adds logit shares at ``price``: store shares (floored) moved by scale times the distance from mean prices, summing to 1."""
    raw = F.greatest("share", F.lit(FLOOR_SHARE)) * F.exp(F.col("scale") * (F.coalesce(price, "mean_price") - F.col("mean_price")))
    return rows.withColumn("__raw", raw).withColumn(out, F.col("__raw") / F.sum("__raw").over(Window.partitionBy(*by))).drop("__raw")


def _store_week_grid(frame: DataFrame, shares: DataFrame, prices: DataFrame, scales: DataFrame, keys: Sequence[str], columns: Sequence[str], cell: Sequence[str]) -> DataFrame:
    """Store-weeks of the frame by all products of the cell, with the frame's mean ``columns`` where it has them."""
    seen = frame.groupBy(*keys, "store_id", "week", "product_id").agg(*[F.avg(c).alias(c) for c in columns])
    places = frame.select(*keys, "store_id", "week").distinct()
    grid = places.join(shares, [*cell, "store_id"]).join(prices, [*cell, "store_id", "product_id"]).join(scales, list(cell))
    return grid.join(seen, [*keys, "store_id", "week", "product_id"], "left")


def predict_units(frame: DataFrame, shares: DataFrame, prices: DataFrame, scales: DataFrame, levels: DataFrame, seasons: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """``predicted_units`` of each row: share at its store-week's prices times market size; 0 for unknown stores."""
    grid = shares_at(_store_week_grid(frame, shares, prices, scales, cell, ["price"], cell), [*cell, "store_id", "week"], "price", "s")
    units = market_size(grid, levels, seasons, cell).select(*cell, "store_id", "week", "product_id", (F.col("s") * F.col("market")).alias("u"))
    return frame.join(units, [*cell, "store_id", "week", "product_id"], "left").select(*cell, "product_id", "store_id", "week", F.coalesce("u", F.lit(0.0)).alias("predicted_units"))


def diverted(rows: DataFrame, by: Sequence[str], base: str, focal_share: str, out: str) -> DataFrame:
    """Adds shares where what the focal loses goes to others in proportion to share times (MIX kernel + 1 - MIX); rows need ``is_focal`` and ``kernel`` (null: plain shares)."""
    w = F.when(~F.col("is_focal"), F.col(base) * F.coalesce(MIX * F.col("kernel") + (1 - MIX), F.lit(1.0))).otherwise(0.0)
    over = Window.partitionBy(*by)
    lost = F.sum(F.when(F.col("is_focal"), F.col(base) - F.col(focal_share))).over(over)
    total = F.sum("__w").over(over)
    moved = F.col(base) + F.when(total > 0, lost * F.col("__w") / total).otherwise(0.0)
    return rows.withColumn("__w", w).withColumn(out, F.when(F.col("is_focal"), F.col(focal_share)).otherwise(moved)).drop("__w")


def sweep_deltas(sweep: DataFrame, shares: DataFrame, prices: DataFrame, scales: DataFrame, rhos: DataFrame, levels: DataFrame, seasons: DataFrame, kernel: DataFrame | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """Predicted change of units of each sweep row, all scenarios in one job: one priced product diverts, several renormalise."""
    keys = [*cell, "intervention_id"]
    moved = sweep.where("abs(intervention_price - baseline_price) > 1e-12").groupBy(*keys).agg(F.count_distinct("product_id").alias("n_focals"), F.min("product_id").alias("focal"))
    grid = _store_week_grid(sweep, shares, prices, scales, keys, ["baseline_price", "intervention_price"], cell).join(moved, keys, "left").join(rhos, list(cell))
    place = [*keys, "store_id", "week"]
    grid = shares_at(shares_at(grid, place, "baseline_price", "s0"), place, "intervention_price", "s1")
    grid = grid.withColumn("is_focal", F.coalesce(F.col("product_id") == F.col("focal"), F.lit(False)))
    if kernel is None:
        grid = grid.withColumn("kernel", F.lit(None).cast("double"))
    else:
        grid = grid.join(kernel.withColumnsRenamed({AFFECTED: "focal", PRICED: "product_id"}), [*cell, "focal", "product_id"], "left")
    grid = diverted(grid, place, "s0", "s1", "s_diverted")
    cf = F.when(F.col("n_focals") == 1, F.col("s_diverted")).otherwise(F.col("s1"))
    gain = F.sum(F.col("s0") * F.exp(F.col("scale") * (F.coalesce("intervention_price", "mean_price") - F.coalesce("baseline_price", "mean_price")))).over(Window.partitionBy(*place))
    grid = market_size(grid.withColumns({"cf": cf, "dcv": F.log(F.greatest(gain, F.lit(1e-9)))}), levels, seasons, cell)
    margin = F.exp(F.least(F.greatest(F.col("rho") * F.col("dcv"), F.lit(-10.0)), F.lit(10.0)))
    delta = grid.select(*place, "product_id", (F.col("cf") * F.col("market") * margin - F.col("s0") * F.col("market")).alias("d"))
    return sweep.join(delta, [*place, "product_id"], "left").select(*keys, "product_id", "store_id", "week", F.coalesce("d", F.lit(0.0)).alias("predicted_delta_units"))


def elasticities(shares: DataFrame, prices: DataFrame, scales: DataFrame, rhos: DataFrame, kernel: DataFrame | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """Arc elasticities at pooled shares and prices, with diversion and incidence."""
    pooled = shares.groupBy(*cell, "product_id").agg(F.avg("share").alias("share")).join(prices.groupBy(*cell, "product_id").agg(F.avg("mean_price").alias("mean_price")), [*cell, "product_id"])
    over_cell = Window.partitionBy(*cell)
    pooled = pooled.withColumn("s0", F.greatest("share", F.lit(FLOOR_SHARE))).withColumn("s0", F.col("s0") / F.sum("s0").over(over_cell))
    grid = product_grid(pooled, cell).join(pooled.select(*cell, F.col("product_id").alias(AFFECTED), "s0"), [*cell, AFFECTED]).join(pooled.select(*cell, F.col("product_id").alias(PRICED), F.col("mean_price").alias("p"), F.col("s0").alias("s_priced")), [*cell, PRICED]).join(scales, list(cell)).join(rhos, list(cell))
    bump = F.exp(F.col("scale") * ARC * F.col("p"))
    grid = grid.withColumns({"is_focal": F.col(AFFECTED) == F.col(PRICED), "dcv": F.log(F.greatest(1 + F.col("s_priced") * (bump - 1), F.lit(1e-9))), "s1": F.col("s_priced") * bump / (1 + F.col("s_priced") * (bump - 1))})
    grid = grid.join(kernel.select(*cell, F.col(AFFECTED).alias(PRICED), F.col(PRICED).alias(AFFECTED), "kernel"), [*cell, AFFECTED, PRICED], "left") if kernel is not None else grid.withColumn("kernel", F.lit(None).cast("double"))
    grid = diverted(grid, [*cell, PRICED], "s0", "s1", "cf")
    margin = F.exp(F.least(F.greatest(F.col("rho") * F.col("dcv"), F.lit(-10.0)), F.lit(10.0)))
    return grid.select(*cell, AFFECTED, PRICED, F.when(F.col("s0") > 0, (F.col("cf") * margin - F.col("s0")) / F.col("s0") / ARC).otherwise(0.0).alias("elasticity"))
