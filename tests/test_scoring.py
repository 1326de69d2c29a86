"""Hand-computed cases of the scoring operators."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import board, bootstrap, counterfactual, elasticity, forecast, validity
from shelfwise.operators.bootstrap import fraction_interval

PANEL = "cell_slug string, product_id string, store_id string, week int"


def test_forecast_scores(spark):
    truth = spark.createDataFrame([("c", "P1", "S1", 1, 100.0), ("c", "P1", "S2", 1, 50.0), ("c", "P2", "S1", 1, 20.0), ("c", "P2", "S2", 1, 30.0)], PANEL + ", true_units double")
    pred = spark.createDataFrame([("c", "P1", "S1", 1, "110"), ("c", "P1", "S2", 1, "40"), ("c", "P2", "S1", 1, "25"), ("c", "P2", "S2", 1, "30"), ("c", "P9", "S2", 1, "30")], PANEL + ", predicted_units string")
    w = spark.createDataFrame([("c", "P1", 0.8), ("c", "P2", 0.2)], "cell_slug string, product_id string, w double")
    r = forecast.demand_scores(pred, truth, w).first()
    assert r.demand_wmape == pytest.approx((0.8 * 20 + 0.2 * 5) / (0.8 * 150 + 0.2 * 50)) and r.demand_wmpe == pytest.approx(0.2 * 5 / 130)
    assert (r.n_truth_rows, r.n_scored_rows, r.n_prediction_rows_ignored_out_of_support, r.submission_complete) == (4, 4, 1, True)
    r = forecast.demand_scores(pred.where("not (product_id = 'P1' and store_id = 'S1')"), truth, w).first()
    assert (r.n_truth_rows_without_prediction, r.submission_complete) == (1, False) and r.demand_wmape == pytest.approx((0.8 * 10 + 0.2 * 5) / (0.8 * 50 + 0.2 * 50))


def test_revenue_weights(spark):
    tx = spark.createDataFrame([("c", "P1", 30.0), ("c", "P2", 10.0), ("c", "P1", 60.0), ("d", "P1", 0.0), ("d", "P2", 0.0)], "cell_slug string, product_id string, dollars double")
    got = {(r.cell_slug, r.product_id): r.w for r in forecast.revenue_weights(tx).collect()}
    assert got == {("c", "P1"): 0.9, ("c", "P2"): 0.1, ("d", "P1"): 0.5, ("d", "P2"): 0.5}


STAR = {("P1", "P1"): -2.0, ("P1", "P2"): 0.5, ("P1", "P3"): 0.01, ("P2", "P1"): 0.4, ("P2", "P2"): -1.5, ("P2", "P3"): -0.3, ("P3", "P1"): 0.02, ("P3", "P2"): 0.6, ("P3", "P3"): -2.5}
HAT = {("P1", "P1"): -1.8, ("P1", "P2"): 0.45, ("P1", "P3"): 0.0, ("P2", "P1"): 0.5, ("P2", "P2"): -1.7, ("P2", "P3"): -0.25, ("P3", "P1"): 0.0, ("P3", "P2"): 0.55, ("P3", "P3"): 2.0}


def matrices(spark, hat):
    truth = spark.createDataFrame([("c", a, p, x) for (a, p), x in STAR.items()], "cell_slug string, affected_product_id string, priced_product_id string, epsilon_star double")
    sent = spark.createDataFrame([("c", a, p, x) for (a, p), x in hat.items()], "cell_slug string, affected_product_id string, priced_product_id string, elasticity double")
    w = spark.createDataFrame([("c", "P1", 0.5), ("c", "P2", 0.3), ("c", "P3", 0.2)], "cell_slug string, product_id string, w double")
    return sent, truth, w


def test_elasticity_scores(spark):
    r = elasticity.elasticity_scores(*matrices(spark, HAT)).first()
    assert r.own_price.sign_accuracy == pytest.approx(2 / 3) and r.own_price.rmse == pytest.approx(math.sqrt((0.04 + 0.04 + 4.5**2) / 3))
    assert r.cross_price.unrelated_abs_threshold == pytest.approx(0.02)
    r = elasticity.elasticity_scores(*matrices(spark, STAR)).first()
    assert r.cross_price.ndcg == pytest.approx(1) and r.cross_price.all_pairs.wmape == pytest.approx(0) and r.own_price.sign_accuracy == 1
    r = elasticity.elasticity_scores(*matrices(spark, {k: x for k, x in HAT.items() if k[1] != "P3"})).first()
    assert r.n_matrix_entries_missing_in_submission == 3 and not r.submission_complete


FRAME = "cell_slug string, intervention_id string, store_id string, week int, product_id string, baseline_units double, dq_true double, dq_pred double"


def headline(spark, rows):
    frame = spark.createDataFrame([("c", "i", s, w, p, float(b), float(t), float(q)) for s, w, p, b, t, q in rows], FRAME)
    return counterfactual.headline(frame, spark.createDataFrame([("c", "i", "F", 1)], "cell_slug string, intervention_id string, focal string, direction int")).first()


def test_headline(spark):
    one = lambda *rows: [("S1", 1, *r) for r in rows]
    r = headline(spark, one(("F", 100, -20, -20), ("A", 50, 8, 8), ("B", 50, 12, 12)))
    assert (r.own_price_wmpe, r.substitution_wape) == (0, 0)
    assert headline(spark, one(("F", 100, -20, -28), ("A", 50, 10, 14), ("B", 50, 10, 14))).own_price_wmpe == pytest.approx(-0.4)
    assert headline(spark, one(("F", 100, -20, -20), ("A", 50, 8, 8), ("B", 50, 6, 10), ("C", 50, 6, 2))).substitution_wape == pytest.approx(0.4)
    r = headline(spark, one(("F", 100, -15, -15), ("A", 50, -7.5, -7.5), ("B", 50, -7.5, -7.5)))
    assert r.own_price_wmpe is None and r.own_price_status == counterfactual.UNSCOREABLE
    r = headline(spark, one(("A", 50, -7.5, -7.5), ("B", 50, -7.5, -7.5)))
    assert r.own_price_wmpe is None and r.n_store_weeks_focal_missing == 1


def test_scenario_map(spark):
    rows = [("c", "i", "F", 10.0, 11.0, 2), ("c", "i", "A", 5.0, 5.0, 1), ("c", "j", "A", 5.0, 4.0, 1), ("c", "k", "A", 5.0, 5.0, 1)]
    got = {r.intervention_id: (r.focal, r.direction) for r in counterfactual.scenario_map(spark.createDataFrame(rows, "cell_slug string, intervention_id string, product_id string, baseline_price double, intervention_price double, row_ord long")).collect()}
    assert got == {"i": ("F", 1), "j": ("A", -1), "k": (None, None)}


def test_signs(spark):
    frame = spark.createDataFrame([("c", "i", "S1", 1, p, 50.0, 0.0, float(x)) for p, x in (("F", -26), ("A", 30), ("B", -2), ("C", -2))], FRAME)
    scenes = spark.createDataFrame([("c", "i", "F", 1)], "cell_slug string, intervention_id string, focal string, direction int")
    r = validity.substitution_sign(frame, scenes, ["cell_slug", "intervention_id"]).first()
    assert r.frac_redistribution_mass_correct == pytest.approx(30 / 34) and r.frac_competitors_correct_count == pytest.approx(1 / 3)
    assert validity.own_price_sign(frame, scenes, ["cell_slug", "intervention_id"]).first().frac_correct_sign == 1
    own = spark.createDataFrame([("c", x) for x in (-1.8, -0.4, 0.5, -50.0)], "cell_slug string, elasticity double")
    r = validity.own_range(own, ["cell_slug"], (-5.0, -0.5)).first()
    assert (r.frac_in_band, r.frac_wrong_sign, r.frac_extreme, r.frac_correct_sign) == (0.25, 0.25, 0.25, 0.75)


def test_gate(spark):
    rows = spark.createDataFrame([(0.2, 0.9), (0.95, 0.3), (0.95, 0.9), (None, None)], "own double, sub double")
    none = F.lit(None).cast("double")
    got = rows.select(validity.coherence_gate(F.col("own"), F.col("sub"), none, none, none).alias("g")).select("g.*").collect()
    assert [r.verdict for r in got] == ["FAIL", "WARN", "PASS", "PASS"] and got[0].fail_reasons == ["own_price_sign 0.20 < 0.90 (law of demand)"]


def test_bootstrap(spark):
    rows = spark.createDataFrame([("g", k, float(k < 3)) for k in range(4)] + [("h", k, 1.0) for k in range(4)], "g string, k int, x double")
    got = {r.g: r for r in fraction_interval(rows, ["g"], ["g", "k"], "x").collect()}
    assert got["g"].ci_low <= 0.75 <= got["g"].ci_high and got["h"].ci_low == 1
    assert fraction_interval(rows, ["g"], ["g", "k"], "x", replicates=0).count() == 0


def test_bootstrap_of_weighted_rows_against_single_draws(spark):
    """Many partitions, null groups and values; the same counts one row and one replicate at a time, and the spread that resampling has."""
    rng = np.random.default_rng(5)
    data = [("g" if k % 3 else None, k, float(rng.random() < 0.7) if k % 50 else None, float(rng.random())) for k in range(3000)]
    rows = spark.createDataFrame(data, "g string, k int, x double, w double").repartition(7)
    got = {r.g: r for r in fraction_interval(rows, ["g"], ["g", "k"], "x", "w", replicates=60, seed=3).collect()}
    for g in ("g", None):
        shares = []
        for m in bootstrap.multipliers(60, 3).tolist():
            top = under = 0.0
            for name, k, x, w in data:
                if name == g:
                    text = "|".join([*([name] if name else []), str(k), "3"])
                    u = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) * m % 2**52 / 2**52
                    n = sum(u >= p for p in bootstrap.POISSON)
                    top, under = top + n * w * (x or 0.0), under + n * w
            shares.append(top / under)
        assert (got[g].ci_low, got[g].ci_high) == pytest.approx(tuple(np.quantile(shares, [0.025, 0.975])), rel=1e-9)
        own = [(x or 0.0, w) for name, _, x, w in data if name == g]
        share = sum(x * w for x, w in own) / sum(w for _, w in own)
        error = np.sqrt(sum((w * (x - share)) ** 2 for x, w in own)) / sum(w for _, w in own)
        assert np.std(shares) == pytest.approx(error, rel=0.35)


def test_leaderboard_over_seeds(spark):
    rows = [("a", f"x_seed{k}", "synthetic", b) for k, b in enumerate((0.8, 0.7, 0.9))] + [("b", "x_seed1", "synthetic", -0.12), ("c", "x_seed1", "synthetic", None), ("d", "x_seed1", "actual", None)]
    payloads = spark.createDataFrame(rows, "submission_name string, cell_slug string, data_arm string, b double").select("submission_name", "cell_slug", "data_arm", F.struct(F.struct(F.struct(F.col("b").alias("own_price_wmpe")).alias("own_price")).alias("headline")).alias("counterfactual_prediction"))
    lb = board.leaderboard(payloads)
    got = {(r.submission, r.data_arm): r for r in board.over_seeds(lb).collect()}
    assert got["a", "synthetic"].own_price_bias == pytest.approx(0.8) and got["a", "synthetic"].own_price_bias_seed_sd == pytest.approx(0.0816, abs=1e-4)
    assert [got[x].rank for x in (("b", "synthetic"), ("a", "synthetic"), ("c", "synthetic"), ("d", "actual"))] == [1, 2, 3, 1]
    shown = {r.submission: r.own_price_bias for r in board.displayed(board.over_seeds(lb)).collect()}
    assert shown["a"] == "0.800 ± 0.082" and shown["b"] == "-0.120" and shown["c"] == ""
