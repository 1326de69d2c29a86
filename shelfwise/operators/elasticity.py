"""Elasticity matrices as long tables (affected, priced): alignment, magnitude, sign, class and rank scores, and truth in closed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import measure, ratio
from shelfwise.operators.quantiles import exact_quantile
from shelfwise.staging import staged

CELL = ("cell_slug",)
AFFECTED, PRICED = "affected_product_id", "priced_product_id"
CLASSES = ("substitute", "complement", "unrelated")
STEP = 0.01


def product_grid(products: DataFrame, cell: Sequence[str] = CELL, product: str = "product_id") -> DataFrame:
    """All (affected, priced) pairs of a cell's products."""
    a = products.select(*cell, F.col(product).alias(AFFECTED)).distinct()
    return a.join(a.withColumnRenamed(AFFECTED, PRICED), list(cell))


def aligned(submitted: DataFrame, truth: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Each entry of the truth's matrix with its submitted value (null if missing), and the entries outside it (``inside`` false).

    An entry is defined if it has a truth and its support isn't false; a missing support counts as true."""
    rows = truth.select(
        *cell, AFFECTED, PRICED, measure("epsilon_star").alias("star"),
        (measure("epsilon_star_conditional") if "epsilon_star_conditional" in truth.columns else F.lit(None).cast("double")).alias("conditional"),
        (F.coalesce(F.col("support").cast("boolean"), F.lit(True)) if "support" in truth.columns else F.lit(True)).alias("support"),
    )
    has_conditional = F.lit("epsilon_star_conditional" in truth.columns)
    a, p = truth.select(*cell, AFFECTED).distinct(), truth.select(*cell, PRICED).distinct()
    grid = a.join(p, list(cell)).join(rows, [*cell, AFFECTED, PRICED], "left")
    sent = submitted.select(*cell, *by, AFFECTED, PRICED, measure("elasticity").alias("sent"))
    if by:
        grid = grid.join(sent.select(*cell, *by).distinct(), list(cell))
    joined = grid.withColumn("inside", F.lit(True)).join(sent, [*cell, *by, AFFECTED, PRICED], "full_outer")
    w = weights.select(*cell, F.col("product_id").alias(AFFECTED), "w")
    defined = F.coalesce(F.col("support") & F.col("star").isNotNull(), F.lit(True) & F.col("star").isNotNull())
    return joined.join(w, [*cell, AFFECTED], "left").select(
        *cell, *by, AFFECTED, PRICED, "star", "conditional", "sent", F.coalesce("inside", F.lit(False)).alias("inside"), defined.alias("defined"),
        F.coalesce("sent", F.lit(0.0)).alias("hat"), F.coalesce("w", F.lit(0.0)).alias("w"), has_conditional.alias("has_conditional"),
    )


def entry_counts(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Completeness over defined entries, and what was ignored."""
    sent, inside, defined = F.col("sent").isNotNull(), F.col("inside"), F.col("defined")
    return entries.groupBy(*keys).agg(
        F.count_distinct(F.when(inside, F.col(AFFECTED))).alias("n_products"),
        F.count_if(inside & ~sent & defined).alias("n_matrix_entries_missing_in_submission"), F.count_if(inside & ~defined).alias("n_entries_unsupported_excluded"),
        F.count_if(~inside & sent).alias("n_submission_entries_ignored_out_of_matrix"), F.count_if(inside & sent & ~defined).alias("n_submission_entries_ignored_unsupported"),
        (F.count_if(inside & ~sent & defined) == 0).alias("submission_complete"),
    )


def magnitude() -> Column:
    """Aggregate struct: WMAPE, RMSE, WMPE, mean signed error and the number of entries."""
    gap, w = F.col("hat") - F.col("star"), F.col("w")
    den = F.sum(w * F.abs("star"))
    return F.struct(
        ratio(F.sum(w * F.abs(gap)), den).alias("wmape"), F.sqrt(F.avg(gap * gap)).alias("rmse"), ratio(F.sum(w * gap), den).alias("wmpe"),
        F.avg(gap).alias("mean_signed_error"), F.count("star").alias("n_entries"),
    )


def own_scores(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Struct ``own_price`` over the defined diagonal."""
    own = entries.where(F.col("inside") & (F.col(AFFECTED) == F.col(PRICED)))
    out = own.groupBy(*keys).agg(F.count_if(~F.col("defined")).alias("excluded"))
    scored = own.where("defined").groupBy(*keys).agg(F.avg((F.signum("hat") == F.signum("star")).cast("double")).alias("sign"), magnitude().alias("m"))
    return out.join(scored, list(keys), "left").select(
        *keys, F.struct(F.col("sign").alias("sign_accuracy"), "m.wmape", "m.rmse", "m.wmpe", "m.mean_signed_error", F.coalesce("m.n_entries", F.lit(0)).alias("n_entries"), F.col("excluded").alias("n_diagonal_excluded_unsupported")).alias("own_price")
    )


def classified(entries: DataFrame, keys: Sequence[str], percent: float = 0.2) -> DataFrame:
    """Defined cross entries with the true and the submitted class.

    Classes are read off the conditional elasticities where the truth has them (the incidence margin is netted out of both sides),
    strictly beyond the quantile of the absolute basis."""
    cross = entries.where(F.col("inside") & F.col("defined") & (F.col(AFFECTED) != F.col(PRICED)))
    cross = cross.withColumns({"basis": F.when(F.col("has_conditional"), F.col("conditional")).otherwise(F.col("star")), "hat_basis": F.when(F.col("has_conditional"), F.col("hat") - (F.col("star") - F.col("conditional"))).otherwise(F.col("hat"))})
    cross = staged(cross, "entries")
    limit = exact_quantile(cross, keys, F.abs("basis"), percent, "limit")
    label = lambda c: F.when(F.col(c) > F.col("limit"), "substitute").when(F.col(c) < -F.col("limit"), "complement").otherwise("unrelated")
    return cross.join(limit, list(keys)).withColumns({"true_class": label("basis"), "hat_class": label("hat_basis")})


def class_scores(cross: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, class): F1, precision and recall; F1 is null only where a class occurs on neither side."""
    each = cross.select(*keys, "true_class", "hat_class", F.explode(F.array(*map(F.lit, CLASSES))).alias("class"))
    true, hat = F.col("true_class") == F.col("class"), F.col("hat_class") == F.col("class")
    n = each.groupBy(*keys, "class").agg(F.count_if(true & hat).alias("tp"), F.count_if(~true & hat).alias("fp"), F.count_if(true & ~hat).alias("fn"))
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p.isNotNull() & r.isNotNull() & (p + r > 0), 2 * p * r / (p + r)).when(F.col("tp") + F.col("fp") + F.col("fn") > 0, 0.0)
    return n.select(*keys, "class", f1.alias("f1"), "precision", "recall", (F.col("tp") + F.col("fn")).alias("n_true"))


def ndcg(entries: DataFrame, keys: Sequence[str], at: int | None = None) -> DataFrame:
    """Mean NDCG over affected products: others ranked by the submitted size, gains of the true one; ties by priced id."""
    cross = entries.where(F.col("inside") & F.col("defined") & (F.col(AFFECTED) != F.col(PRICED)))
    row = Window.partitionBy(*keys, AFFECTED)
    ranked = cross.withColumns({"gain": F.abs("star"), "by_hat": F.row_number().over(row.orderBy(F.desc(F.abs("hat")), PRICED)), "by_star": F.row_number().over(row.orderBy(F.desc(F.abs("star")), PRICED))})
    inside = lambda c: F.lit(True) if at is None else F.col(c) <= at
    part = lambda c: F.sum(F.when(inside(c), F.col("gain") / F.log2(F.col(c) + 1.0)).otherwise(0.0))
    each = ranked.groupBy(*keys, AFFECTED).agg(part("by_hat").alias("dcg"), part("by_star").alias("ideal"))
    return each.groupBy(*keys).agg(F.avg(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))).alias("ndcg"))


def elasticity_scores(submitted: DataFrame, truth: DataFrame, weights: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = (), percent: float = 0.2) -> DataFrame:
    """One row for each cell (and each ``by``): counts, struct ``own_price``, struct ``cross_price``."""
    keys = [*cell, *by]
    entries = aligned(submitted, truth, weights, cell, by)
    cross = classified(entries, keys, percent)
    labels = class_scores(cross, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("f1", "precision", "recall", "n_true")))).alias("f1_per_class"))
    pairs = cross.groupBy(*keys).agg(magnitude().alias("all_pairs"), F.max("limit").alias("unrelated_abs_threshold"), F.max("has_conditional").alias("has_conditional"))
    classes = cross.groupBy(*keys, "true_class").agg(magnitude().alias("m")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("true_class", "m"))).alias("by_true_class"))
    out = entry_counts(entries, keys).join(own_scores(entries, keys), keys, "left")
    for part in (labels, pairs, classes, ndcg(entries, keys), ndcg(entries, keys, 5).withColumnRenamed("ndcg", "ndcg_at_5")):
        out = out.join(part, keys, "left")
    basis = F.when(F.col("has_conditional"), "conditional_switching_incidence_netted_out").otherwise("total")
    return out.withColumn("cross_price", F.struct("f1_per_class", "ndcg", "ndcg_at_5", "all_pairs", "by_true_class", "unrelated_abs_threshold", basis.alias("classification_basis"))).drop("f1_per_class", "ndcg", "ndcg_at_5", "all_pairs", "by_true_class", "unrelated_abs_threshold", "has_conditional")


def loglog_truth(own: DataFrame, cross: DataFrame, sensitivity: DataFrame | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """Elasticities of constant-elasticity demand at a step of 1 %, averaged over stores' sensitivities if given.

    own: product_id, own_elasticity; cross: priced, affected, cross_elasticity; sensitivity: store_id, sensitivity."""
    own = own.select(*cell, "product_id", "own_elasticity")
    grid = product_grid(own, cell).join(cross, [*cell, PRICED, AFFECTED], "left").join(own.withColumnRenamed("product_id", AFFECTED), [*cell, AFFECTED], "left")
    effect = F.coalesce("cross_elasticity", F.lit(0.0)) + F.when(F.col(AFFECTED) == F.col(PRICED), F.col("own_elasticity")).otherwise(0.0)
    step = lambda e: (F.pow(F.lit(1 + STEP), e) - 1) / STEP
    if sensitivity is None:
        return grid.select(*cell, AFFECTED, PRICED, step(effect).alias("epsilon_star"))
    return grid.withColumn("e", effect).join(sensitivity, list(cell)).groupBy(*cell, AFFECTED, PRICED).agg(F.avg(step(F.col("sensitivity") * F.col("e"))).alias("epsilon_star"))


def elasticity_from_deltas(deltas: DataFrame, baseline: DataFrame, cell: Sequence[str] = CELL, step: float = STEP) -> DataFrame:
    """Elasticities of a model's own deltas at a price step: sum of deltas over step times baseline units.

    deltas: priced_product_id, product_id, store_id, week, predicted_delta_units; baseline: product_id, store_id, week, predicted_units."""
    total = baseline.groupBy(*cell, F.col("product_id").alias(AFFECTED)).agg(F.sum("predicted_units").alias("q"))
    moved = deltas.groupBy(*cell, F.col("product_id").alias(AFFECTED), PRICED).agg(F.sum("predicted_delta_units").alias("dq"))
    return moved.join(total, [*cell, AFFECTED]).select(*cell, AFFECTED, PRICED, ratio(F.col("dq"), step * F.col("q")).alias("elasticity"))
