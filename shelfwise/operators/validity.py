"""Coherence checks without labels: signs, substitution, plausible ranges, monotonicity, and the gate over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import filled, measure, ratio
from shelfwise.operators.counterfactual import netted, scenario_map
from shelfwise.operators.forecast import KEY

CELL = ("cell_slug",)
#: Own-price bands and the size beyond which an elasticity is extreme.
GENERIC_BAND, TISSUE_BAND, EXTREME = (-5.0, -0.2), (-3.0, -1.0), 8.0
#: Thresholds of the gate.
GATE = {"own_sign_min": 0.90, "substitution_min": 0.55, "in_band_min": 0.80, "monotonicity_min": 0.90}


def own_price_sign(frame: DataFrame, scenarios: DataFrame, keys: Sequence[str], zero_tol: float = 0.0) -> DataFrame:
    """Share of the focal's store-weeks that respond against the price; responses within ``zero_tol`` are ambiguous."""
    own = frame.join(scenarios, [k for k in keys if k in scenarios.columns]).where("product_id = focal")
    moved = F.abs("dq_pred") > zero_tol
    right = moved & (F.signum("dq_pred") == -F.col("direction"))
    n, good = F.count_if(moved), F.count_if(right)
    return own.groupBy(*keys, "focal").agg((-F.first("direction")).alias("expected_sign"), F.count(F.lit(1)).alias("n_focal_store_weeks"), n.alias("n_evaluated"), F.count_if(~moved).alias("n_ambiguous_zero"), ratio(good, n).alias("frac_correct_sign"), ratio(n - good, n).alias("frac_wrong_sign"))


def substitution_sign(frame: DataFrame, scenarios: DataFrame, keys: Sequence[str], complements: DataFrame | None = None, resid_tol: float = 0.0) -> DataFrame:
    """Share of competitors' net responses with the demanded sign, by mass and by count; known complements (cell, product_id) have the other sign."""
    rows = netted(frame, keys, ("dq_pred",)).join(scenarios.where("focal is not null and direction is not null"), [k for k in keys if k in scenarios.columns]).where("product_id <> focal")
    if complements is None:
        rows = rows.withColumn("complement", F.lit(False))
    else:
        on = [c for c in complements.columns if c != "product_id"]
        rows = rows.join(complements.distinct().withColumn("known", F.lit(True)), [*on, "product_id"], "left").withColumn("complement", F.coalesce("known", F.lit(False)))
    r = F.col("net_dq_pred")
    signal = F.abs(r) > resid_tol
    right = signal & (F.signum(r) == F.when(F.col("complement"), -F.col("direction")).otherwise(F.col("direction")))
    mass = F.sum(F.when(signal, F.abs(r)))
    return rows.groupBy(*keys, "focal").agg(
        F.first("direction").alias("expected_competitor_sign"), F.count_distinct(F.when(F.col("complement"), F.col("product_id"))).alias("n_complements_seen"),
        ratio(F.coalesce(F.sum(F.when(right, F.abs(r))), F.lit(0.0)), mass).alias("frac_redistribution_mass_correct"), ratio(F.count_if(right), F.count_if(signal)).alias("frac_competitors_correct_count"),
        F.count_if(signal).alias("n_competitor_observations_scored"), F.sum(F.abs(r)).alias("total_competitor_mass"),
    )


def own_range(own: DataFrame, keys: Sequence[str], band: tuple[float, float] = GENERIC_BAND, extreme: float = EXTREME, value: str = "elasticity") -> DataFrame:
    """Shares of own elasticities within the band, of the right and the wrong sign (0 is wrong), and extreme."""
    e = measure(value)
    share = lambda x: F.avg(F.when(e.isNotNull(), x.cast("double")))
    return own.groupBy(*keys).agg(F.count(e).alias("n_products"), share(e.between(*band)).alias("frac_in_band"), share(e < 0).alias("frac_correct_sign"), share(e >= 0).alias("frac_wrong_sign"), share(F.abs(e) > extreme).alias("frac_extreme"))


def cross_plausibility(entries: DataFrame, keys: Sequence[str], extreme: float = EXTREME, expected_sign: int | None = None) -> DataFrame:
    """Shares of cross elasticities that are extreme, that reach the priced product's own, and that have the expected sign."""
    e = entries.select(*keys, "affected_product_id", "priced_product_id", measure("elasticity").alias("e"))
    own = e.where("affected_product_id = priced_product_id").select(*keys, "priced_product_id", F.col("e").alias("own"))
    cross = e.where("affected_product_id <> priced_product_id and e is not null").join(own, [*keys, "priced_product_id"], "left")
    prior = F.avg((F.signum("e") == expected_sign).cast("double")) if expected_sign is not None else F.lit(None).cast("double")
    return cross.groupBy(*keys).agg(
        F.count("e").alias("n_cross_entries"), F.avg((F.abs("e") > extreme).cast("double")).alias("frac_cross_extreme"),
        F.avg(F.when(F.abs("own") > 0, (F.abs("e") >= F.abs("own")).cast("double"))).alias("frac_cross_exceeds_own"), prior.alias("frac_cross_matches_prior"),
    )


def monotonicity(frame: DataFrame, scenarios: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Share of store-weeks where the focal falls under the rise and rises under the cut; pairs of scenarios with one focal."""
    own = frame.join(scenarios, [*cell, "intervention_id"]).where("product_id = focal")
    legs = {1: "dq_up", -1: "dq_dn"}
    up, dn = (own.where(F.col("direction") == d).select(*cell, *by, "focal", "store_id", "week", F.col("dq_pred").alias(n)) for d, n in legs.items())
    both = up.join(dn, [*cell, *by, "focal", "store_id", "week"])
    return both.groupBy(*cell, *by, "focal").agg(F.count(F.lit(1)).alias("n_store_weeks"), F.avg(((F.col("dq_up") < 0) & (F.col("dq_dn") > 0)).cast("double")).alias("frac_consistent"))


def _reason(name: str, value: Column, least: float) -> Column:
    return F.when(value < least, F.format_string(f"{name} %.2f < {least:.2f}", value))


def coherence_gate(own_sign: Column, substitution: Column, in_band: Column, wrong_sign: Column, monotone: Column, limits: dict[str, float] = GATE) -> Column:
    """Struct of verdict (FAIL for wrong own-price signs, WARN for weak other rates, else PASS) and reasons; missing rates are skipped."""
    own_min = limits["own_sign_min"]
    fails = F.array_compact(F.array(F.when(own_sign < own_min, F.format_string(f"own_price_sign %.2f < {own_min:.2f} (law of demand)", own_sign))))
    warns = F.array_compact(F.array(
        _reason("substitution_mass", substitution, limits["substitution_min"]), _reason("in_band", in_band, limits["in_band_min"]),
        F.when(wrong_sign > 0, F.format_string("own_elasticity_wrong_sign present (%.2f)", wrong_sign)), _reason("monotonicity", monotone, limits["monotonicity_min"]),
    ))
    verdict = F.when(F.size(fails) > 0, "FAIL").when(F.size(warns) > 0, "WARN").otherwise("PASS")
    return F.struct(verdict.alias("verdict"), fails.alias("fail_reasons"), warns.alias("warn_reasons"), *[F.lit(v).alias(k) for k, v in limits.items()])


def weighted_fraction(fraction: str, weight: str) -> Column:
    """Aggregate: mean of the fractions by weight; missing ones and weights that aren't positive don't count."""
    ok = F.col(fraction).isNotNull() & (F.col(weight) > 0)
    return F.sum(F.when(ok, F.col(fraction) * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))


def sweep_frame(context: DataFrame, deltas: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Sweep rows with submitted deltas, 0 where there is none."""
    on = [*cell, "intervention_id", *KEY]
    sent = deltas.select(*on, *by, "predicted_delta_units")
    rows = context.join(sent.select(*cell, *by).distinct(), list(cell)) if by else context
    return rows.join(sent, [*on, *by], "left").withColumns({"dq_pred": filled("predicted_delta_units"), "baseline_units": filled("baseline_units")})


def derived_elasticities(frame: DataFrame, scenarios: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = ()) -> DataFrame:
    """Own elasticity of each focal from its deltas, of the rise if there is one, else of the cut."""
    rows = frame if "row_ord" in frame.columns else frame.withColumn("row_ord", F.lit(0))
    pct = F.try_divide(measure("intervention_price") - measure("baseline_price"), measure("baseline_price"))
    own = rows.join(scenarios.where("direction is not null"), [*cell, "intervention_id"]).where("product_id = focal").withColumn("pct", pct)
    legs = own.groupBy(*cell, *by, "focal", "direction").agg(F.sum("baseline_units").alias("base"), F.sum("dq_pred").alias("dq"), F.min_by("pct", F.when(F.col("pct").isNotNull(), F.struct("row_ord", "store_id", "week"))).alias("pct"))
    leg = legs.groupBy(*cell, *by, "focal").agg(F.max_by(F.struct("base", "dq", "pct"), "direction").alias("leg"))
    return leg.select(*cell, *by, F.col("focal").alias("product_id"), F.when((F.col("leg.base") != 0) & (F.col("leg.pct") != 0), F.col("leg.dq") / F.col("leg.base") / F.col("leg.pct")).alias("elasticity"))


def score_validity(context: DataFrame, deltas: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = (), band: tuple[float, float] = TISSUE_BAND) -> DataFrame:
    """One row for each cell (and each ``by``): rates over all focals, and the gate. The rise of each focal is scored, the cut where there is no rise."""
    keys = [*cell, *by]
    frame, scenarios = sweep_frame(context, deltas, cell, by), scenario_map(context, cell).where("focal is not null and direction is not null")
    legs = scenarios.groupBy(*cell, "focal").agg(F.max("direction").alias("direction"))
    chosen = scenarios.join(legs, [*cell, "focal", "direction"])
    on = [*keys, "intervention_id"]
    own = own_price_sign(frame, chosen, on).groupBy(*keys).agg(weighted_fraction("frac_correct_sign", "n_evaluated").alias("own_price_sign"))
    sub = substitution_sign(frame, chosen, on).groupBy(*keys).agg(
        weighted_fraction("frac_redistribution_mass_correct", "total_competitor_mass").alias("substitution_mass"), weighted_fraction("frac_competitors_correct_count", "n_competitor_observations_scored").alias("substitution_count"),
    )
    mono = monotonicity(frame, scenarios, cell, by).groupBy(*keys).agg(weighted_fraction("frac_consistent", "n_store_weeks").alias("monotonicity"))
    ranges = own_range(derived_elasticities(frame, scenarios, cell, by), keys, band)
    focals = scenarios.groupBy(*cell).agg(F.count_distinct("focal").alias("n_focals"))
    out = ranges.join(own, keys, "left").join(sub, keys, "left").join(mono, keys, "left").join(focals, list(cell), "left")
    return out.withColumn("gate", coherence_gate(F.col("own_price_sign"), F.col("substitution_mass"), F.col("frac_in_band"), F.col("frac_wrong_sign"), F.col("monotonicity")))


def scenario_checks(context: DataFrame, deltas: DataFrame, cell: Sequence[str] = CELL, by: Sequence[str] = (), elasticities: DataFrame | None = None, band: tuple[float, float] = GENERIC_BAND, complements: DataFrame | None = None, expected_sign: int | None = None, paired: bool = True, resid_tol: float = 0.0) -> DataFrame:
    """One row for each scenario with a focal (and each ``by``): its own and substitution signs and the gate over them.

    ``elasticities`` (cell, by, affected, priced, elasticity) add range and cross plausibility of the cell; ``paired`` adds monotonicity
    against the scenario of the same focal that moves the other way. What isn't asked for, or has no counterpart, is null and doesn't gate."""
    keys = [*cell, *by]
    frame, scenarios = sweep_frame(context, deltas, cell, by), scenario_map(context, cell).where("focal is not null and direction is not null")
    on = [*keys, "intervention_id"]
    own = own_price_sign(frame, scenarios, on).select(*on, "focal", F.col("frac_correct_sign").alias("own_price_sign"), "n_evaluated")
    sub = substitution_sign(frame, scenarios, on, complements, resid_tol).select(*on, F.col("frac_redistribution_mass_correct").alias("substitution_mass"), F.col("frac_competitors_correct_count").alias("substitution_count"))
    out = own.join(sub, on, "left")
    if elasticities is not None:
        diagonal = elasticities.where("affected_product_id = priced_product_id")
        out = out.join(own_range(diagonal, keys, band), keys, "left").join(cross_plausibility(elasticities, keys, expected_sign=expected_sign), keys, "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in ("frac_in_band", "frac_wrong_sign")})
    if paired:
        mono = monotonicity(frame, scenarios, cell, by).select(*keys, "focal", F.col("frac_consistent").alias("monotonicity"))
        out = out.join(mono, [*keys, "focal"], "left")
    else:
        out = out.withColumn("monotonicity", F.lit(None).cast("double"))
    return out.withColumn("gate", coherence_gate(F.col("own_price_sign"), F.col("substitution_mass"), F.col("frac_in_band"), F.col("frac_wrong_sign"), F.col("monotonicity")))
