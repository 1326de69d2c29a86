"""Price scenarios: who is priced, responses net of the category's, and the pooled own-price and substitution errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import close, filled, measure
from shelfwise.operators.forecast import KEY, out_of_support

CELL = ("cell_slug",)
MASS_FLOOR = 1.0  # units of true response below which a ratio says nothing
FLAGSHIP = "sweep_single_share_highest_plus10"
UNSCOREABLE = "unscoreable_truth_mass_below_floor"


def _first(value, moved):
    """Of the first moved row in source order; without an order, of the least product."""
    return F.min_by(value, F.when(moved, F.struct("row_ord", "product_id")))


def scenario_map(context: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, intervention_id, focal, direction): the first product whose price moves, and +1 or -1 of the first moved price; null if none.

    The two tests differ: the focal's is relative to the baseline price, the direction's isn't. A missing price counts as moved."""
    rows = context if "row_ord" in context.columns else context.withColumn("row_ord", F.lit(0))
    base, new = measure("baseline_price"), measure("intervention_price")
    focal_moved, step_moved = ~close(new, base), ~F.coalesce(F.abs(new - base) <= 1e-8, F.lit(False))
    return rows.groupBy(*cell, "intervention_id").agg(
        _first(F.col("product_id"), focal_moved).alias("focal"),
        _first(F.when(new - base > 0, 1).otherwise(-1), step_moved).alias("direction"),
    )


def netted(frame: DataFrame, by: Sequence[str], deltas: Sequence[str] = ("dq_true", "dq_pred")) -> DataFrame:
    """Adds ``net_<delta>``: the response less the store-week's total response in proportion to baseline units."""
    over = Window.partitionBy(*by, "store_id", "week")
    total = F.sum("baseline_units").over(over)
    share = F.when(total > 0, F.col("baseline_units") / total).otherwise(0.0)
    return frame.withColumns({f"net_{d}": F.col(d) - F.sum(d).over(over) * share for d in deltas})


def scenario_frame(truth: DataFrame, deltas: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Truth rows with submitted deltas; those without one count as 0, and ``unsent`` marks them."""
    on = [*cell, "intervention_id", *KEY]
    sent = deltas.select(*on, *by, F.col("predicted_delta_units").alias("raw"))
    rows = truth.join(sent.select(*cell, *by).distinct(), list(cell)) if by else truth
    return rows.join(sent, [*on, *by], "left").select(
        *on, *by, filled("baseline_units").alias("baseline_units"), F.coalesce(measure("true_counterfactual_units") - measure("baseline_units"), F.lit(0.0)).alias("dq_true"),
        filled("raw").alias("dq_pred"), F.col("raw").isNull().alias("unsent"), *(["row_ord"] if "row_ord" in truth.columns else []),
    )


def headline(frame: DataFrame, scenarios: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """One row a scenario: signed own-price error and unsigned substitution error of net responses, pooled over store-weeks with the focal.

    Store-weeks without the focal count as missing and enter neither. Of several focal rows of a store-week the first stands, and none is a competitor."""
    keys = [*cell, *by, "intervention_id"]
    order = F.col("row_ord") if "row_ord" in frame.columns else F.lit(0)
    rows = netted(frame, keys).join(scenarios.select(*cell, "intervention_id", "focal").where("focal is not null"), [*cell, "intervention_id"])
    at = Window.partitionBy(*keys, "store_id", "week")
    rows = rows.withColumn("is_focal", F.col("product_id") == F.col("focal"))
    rows = rows.withColumns({"carried": F.max("is_focal").over(at), "nth": F.row_number().over(Window.partitionBy(*keys, "store_id", "week", "is_focal").orderBy(order))})
    own, rival = F.col("is_focal") & (F.col("nth") == 1), F.col("carried") & ~F.col("is_focal")
    gap = F.col("net_dq_pred") - F.col("net_dq_true")
    place = F.struct("store_id", "week")
    out = rows.groupBy(*keys, "focal").agg(
        F.coalesce(F.sum(F.when(own, gap)), F.lit(0.0)).alias("own_signed_sum"), F.coalesce(F.sum(F.when(own, F.abs("net_dq_true"))), F.lit(0.0)).alias("own_abs_true_sum"),
        F.coalesce(F.sum(F.when(rival, F.abs(gap))), F.lit(0.0)).alias("sub_abs_err_sum"), F.coalesce(F.sum(F.when(rival, F.abs("net_dq_true"))), F.lit(0.0)).alias("sub_abs_true_sum"),
        F.count_distinct(F.when(rival & (F.col("nth") == 1), place)).alias("n_store_weeks_scored"), F.count_distinct(F.when(~F.col("carried"), place)).alias("n_store_weeks_focal_missing"),
        F.count_distinct(F.when(F.col("carried"), F.col("store_id"))).alias("n_stores_focal_carrying"), F.count_distinct("store_id").alias("n_stores_total"),
    )
    pooled = lambda num, den: F.when(F.col(den) > MASS_FLOOR, F.col(num) / F.col(den))
    status = lambda den: F.when(F.col(den) > MASS_FLOOR, "scored").otherwise(UNSCOREABLE)
    return out.withColumns({"own_price_wmpe": pooled("own_signed_sum", "own_abs_true_sum"), "substitution_wape": pooled("sub_abs_err_sum", "sub_abs_true_sum"), "own_price_status": status("own_abs_true_sum"), "substitution_status": status("sub_abs_true_sum")})


def score_scenarios(truth: DataFrame, deltas: DataFrame, context: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """All scenarios of all cells in one job: ``headline`` with row counts; scenarios without a focal have that as their status."""
    keys = [*cell, *by, "intervention_id"]
    frame = scenario_frame(truth, deltas, cell, by)
    scenarios = scenario_map(context, cell)
    counts = frame.groupBy(*keys).agg(F.count_if(F.col("unsent")).alias("n_truth_rows_without_submission"))
    sent = deltas.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_submitted_rows"))
    ignored = out_of_support(deltas.select(*keys, *KEY), truth, [*cell, "intervention_id", *KEY], keys, "n_submission_rows_ignored_out_of_support")
    scored = headline(frame, scenarios, cell, by)
    out = counts.join(scored, keys, "left").join(sent, keys, "left").join(ignored, keys, "left")
    return out.withColumns({
        "status": F.when(F.col("focal").isNull(), "no_focal_in_public_context").otherwise("scored"),
        "n_submitted_rows": F.coalesce("n_submitted_rows", F.lit(0)), "n_submission_rows_ignored_out_of_support": F.coalesce("n_submission_rows_ignored_out_of_support", F.lit(0)),
    })


def flagship(scored: DataFrame, scenario: str = FLAGSHIP) -> DataFrame:
    """The headline scenario's rows."""
    return scored.where(F.col("intervention_id") == scenario)


def own_price_sweep(panel: DataFrame, eval_weeks: DataFrame, products: DataFrame | None = None, percent: float = 0.10, cell: Sequence[str] = CELL) -> DataFrame:
    """Each product priced up and down once over its store-weeks of the evaluation weeks."""
    rows = panel.join(eval_weeks, [*cell, "week"], "left_semi")
    if products is not None:
        rows = rows.join(products.select(*cell, "product_id").distinct(), [*cell, "product_id"], "left_semi")
    legs = F.explode(F.array(F.struct(F.lit("plus").alias("tag"), F.lit(1 + percent).alias("by")), F.struct(F.lit("minus").alias("tag"), F.lit(1 - percent).alias("by")))).alias("leg")
    return rows.select("*", legs).select(
        *cell, F.concat(F.lit("actual_own_sweep_"), "product_id", F.lit("_"), "leg.tag").alias("intervention_id"), *KEY,
        F.col("price").alias("baseline_price"), (F.col("price") * F.col("leg.by")).alias("intervention_price"), F.col("units").alias("baseline_units"),
    )
