"""Forecast scoring: revenue weights, observed truth, error and bias."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import filled, measure, ratio

KEY = ("product_id", "store_id", "week")
CELL = ("cell_slug",)


def last_weeks(panel: DataFrame, n: int, cell: Sequence[str] = CELL) -> DataFrame:
    """The last ``n`` different weeks of each cell."""
    weeks = panel.where("week is not null").select(*cell, "week").distinct()
    return weeks.withColumn("place", F.dense_rank().over(Window.partitionBy(*cell).orderBy(F.desc("week")))).where(F.col("place") <= n).drop("place")


def split_weeks(panel: DataFrame, eval_weeks: DataFrame, cell: Sequence[str] = CELL) -> tuple[DataFrame, DataFrame]:
    """(training, evaluation) rows."""
    on = [*cell, "week"]
    return panel.join(eval_weeks, on, "left_anti"), panel.join(eval_weeks, on, "left_semi")


def revenue_weights(training: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(cell, product_id, w): share of the cell's revenue; the same for all where it has none."""
    each = training.where("product_id is not null").groupBy(*cell, "product_id").agg(F.sum(filled("dollars")).alias("revenue"))
    over = Window.partitionBy(*cell)
    total = F.sum("revenue").over(over)
    return each.select(*cell, "product_id", F.when(total > 0, F.col("revenue") / total).otherwise(1.0 / F.count(F.lit(1)).over(over)).alias("w"))


def support_pairs(training: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """(product, store) pairs with units in training."""
    return training.where(filled("units") > 0).select(*cell, "product_id", "store_id").distinct()


def demand_truth(panel: DataFrame, eval_weeks: DataFrame, support: DataFrame | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """Observed units of the evaluation weeks, of supported pairs only if these are given."""
    _, held = split_weeks(panel, eval_weeks, cell)
    if support is not None:
        held = held.join(support, [*cell, "product_id", "store_id"], "left_semi")
    return held.select(*cell, *KEY, filled("units").alias("true_units"))


def out_of_support(rows: DataFrame, truth: DataFrame, on: Sequence[str], by: Sequence[str], name: str = "n_ignored") -> DataFrame:
    """How many rows of each ``by`` have a key that the truth doesn't; keys with nulls match nulls."""
    known = truth.select(*[F.col(c).alias(f"__{c}") for c in on]).distinct()
    match = None
    for c in on:
        same = rows[c].eqNullSafe(known[f"__{c}"])
        match = same if match is None else match & same
    return rows.join(known, match, "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def demand_scores(predictions: DataFrame, truth: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """One row for each cell (and each ``by``, which the predictions carry): WMAPE, WMPE and coverage.

    Truth without a prediction isn't scored but counted; predictions without truth are counted and ignored."""
    on, keys = [*cell, *KEY], [*cell, *by]
    pred = predictions.select(*keys, *KEY, measure("predicted_units").alias("predicted_units"))
    n_truth = truth.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_truth_rows"))
    each_truth = truth.join(pred.select(*keys).distinct(), list(cell)) if by else truth
    merged = each_truth.join(pred, [*on, *by], "left")
    scored = F.col("predicted_units").isNotNull()
    error = F.when(scored, F.col("predicted_units") - F.col("true_units"))
    per_product = merged.groupBy(*keys, "product_id").agg(
        F.sum(F.abs(error)).alias("abs_err"), F.sum(error).alias("err"), F.sum(F.when(scored, F.abs("true_units"))).alias("abs_true"),
        F.count("predicted_units").alias("n_scored"), F.count(F.lit(1)).alias("n"),
    )
    w = F.coalesce("w", F.lit(0.0))
    total = per_product.join(weights, [*cell, "product_id"], "left").groupBy(*keys).agg(
        F.sum(w * F.col("abs_err")).alias("e"), F.sum(w * F.col("err")).alias("b"), F.sum(w * F.col("abs_true")).alias("d"),
        F.sum("n_scored").alias("n_scored_rows"), F.sum(F.col("n") - F.col("n_scored")).alias("missing"),
    )
    ignored = out_of_support(pred, truth, on, keys)
    return total.join(ignored, keys, "left").join(n_truth, list(cell)).select(
        *keys, ratio(F.col("e"), F.col("d")).alias("demand_wmape"), ratio(F.col("b"), F.col("d")).alias("demand_wmpe"), "n_truth_rows", "n_scored_rows",
        F.col("missing").alias("n_truth_rows_without_prediction"), F.coalesce("n_ignored", F.lit(0)).alias("n_prediction_rows_ignored_out_of_support"), (F.col("missing") == 0).alias("submission_complete"),
    )


def naive_forecast(training: DataFrame, wanted: DataFrame, weeks: int = 8, cell: Sequence[str] = CELL) -> DataFrame:
    """Mean units of the pair over the last training weeks, 0 if it has none there."""
    _, recent = split_weeks(training, last_weeks(training, weeks, cell), cell)
    mean = recent.groupBy(*cell, "product_id", "store_id").agg(F.avg("units").alias("mean_units"))
    return wanted.join(mean, [*cell, "product_id", "store_id"], "left").select(*cell, *KEY, F.coalesce("mean_units", F.lit(0.0)).alias("predicted_units"))


def naive_elasticities(products: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """Zero for each pair of a cell's products; the product tables are small, pairs are the answer's own size."""
    a = products.select(*cell, F.col("product_id").alias("affected_product_id"))
    return a.join(products.select(*cell, F.col("product_id").alias("priced_product_id")), list(cell)).withColumn("elasticity", F.lit(0.0))


def naive_deltas(sweep: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    return sweep.select(*cell, "intervention_id", *KEY).distinct().withColumn("predicted_delta_units", F.lit(0.0))
