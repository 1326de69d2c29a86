"""Queries over whole scoring runs: payloads of two submissions on all cells, leaderboard and diagnostics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import board
from shelfwise.operators.counterfactual import own_price_sweep
from shelfwise.plans import scoring
from shelfwise.queries import views as v
from shelfwise.queries.scoring import rounded
from shelfwise.staging import fewer_files, staged

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = v.SQL + sql
        return f

    return add


def _both(df: DataFrame, value: str) -> DataFrame:
    """The table as submission ``full``, and with half its values as ``half``."""
    return df.withColumn("submission_name", F.lit("full")).unionByName(df.withColumns({"submission_name": F.lit("half"), value: F.col(value) / 2}))


def payloads(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    p = v.panel(spark, d) if p is None else p
    rows = staged(fewer_files(v.scenario_rows(p)), "scenarios")
    config = p.select("cell_slug").distinct().select("cell_slug", F.lit("test").alias("benchmark_version"), F.lit("log_log").alias("family"))
    keys = config.select("cell_slug").crossJoin(spark.createDataFrame([("full",), ("half",)], "submission_name string"))
    return scoring.evaluate(keys, config, p, v.weeks(p), v.matrix_truth(p), rows, rows, _both(v.predictions(p), "predicted_units"), _both(v.matrix(p), "elasticity"), _both(v.deltas(p), "predicted_delta_units"))


BOARD = """, subs(submission, f) AS (VALUES ('full', 1.0), ('half', 0.5)),
fs AS (SELECT subs.submission, truth.cell_slug, truth.product_id, sum(abs(predicted_units * CAST(f AS DOUBLE) - true_units)) AS ae, sum(CASE WHEN predicted_units IS NOT NULL THEN true_units END) AS tru FROM truth LEFT JOIN pred USING (cell_slug, product_id, store_id, week), subs GROUP BY 1, 2, 3),
fe AS (SELECT submission, cell_slug, sum(w * ae) / sum(w * tru) AS forecast_error FROM fs JOIN weights USING (cell_slug, product_id) GROUP BY 1, 2),
hh AS (SELECT submission, net.cell_slug, sum(CASE WHEN product_id = focal THEN net_pred * CAST(f AS DOUBLE) - net_true END) / sum(CASE WHEN product_id = focal THEN abs(net_true) END) AS own_price_bias,
  sum(CASE WHEN carried AND product_id <> focal THEN abs(net_pred * CAST(f AS DOUBLE) - net_true) END) / sum(CASE WHEN carried AND product_id <> focal THEN abs(net_true) END) AS substitution_error
  FROM (SELECT net.*, focal, max(product_id = focal) OVER (PARTITION BY cell_slug, intervention_id, store_id, week) AS carried FROM net JOIN scenmap USING (cell_slug, intervention_id) WHERE intervention_id = 'sweep_single_share_highest_plus10') net, subs GROUP BY 1, 2),
lb AS (SELECT submission, regexp_replace(cell_slug, '_seed[0-9]+$', '') AS cell_type, cell_slug, own_price_bias, substitution_error, forecast_error FROM hh JOIN fe USING (submission, cell_slug))"""


@query("leaderboard", BOARD + " SELECT row_number() OVER (PARTITION BY cell_type ORDER BY abs(own_price_bias), submission) AS rank, submission, cell_type, cell_slug, 'synthetic' AS data_arm, round(own_price_bias, 6) AS own_price_bias, round(substitution_error, 6) AS substitution_error, round(forecast_error, 6) AS forecast_error FROM lb")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    out = board.leaderboard(payloads(spark, d))
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "submission", "cell_type", "cell_slug", "data_arm", "own_price_bias", "substitution_error", "forecast_error"))


@query("seed_aggregate", BOARD + """, ag AS (SELECT submission, cell_type, count(DISTINCT cell_slug) AS n_seeds, avg(own_price_bias) AS b, stddev_pop(own_price_bias) AS s, avg(forecast_error) AS e FROM lb GROUP BY 1, 2)
SELECT row_number() OVER (PARTITION BY cell_type ORDER BY abs(b), submission) AS rank, submission, cell_type, n_seeds, round(b, 6) AS own_price_bias, round(s, 6) AS own_price_bias_seed_sd, round(e, 6) AS forecast_error FROM ag""")
def seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = board.over_seeds(board.leaderboard(payloads(spark, d)))
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "submission", "cell_type", "n_seeds", "own_price_bias", "own_price_bias_seed_sd", "forecast_error"))


_MATRIX = """, ent AS (SELECT subs.submission, e.*, coalesce(sent * CAST(f AS DOUBLE), 0.0) AS h FROM entries e, subs WHERE support),
ow AS (SELECT submission, cell_slug, avg(CASE WHEN sign(h) = sign(epsilon_star) THEN 1.0 ELSE 0.0 END) AS sign_accuracy, sum(w * abs(h - epsilon_star)) / sum(w * abs(epsilon_star)) AS wmape, sqrt(avg(pow(h - epsilon_star, 2))) AS rmse, sum(w * (h - epsilon_star)) / sum(w * abs(epsilon_star)) AS wmpe, avg(h - epsilon_star) AS mean_signed_error FROM ent WHERE i = j GROUP BY 1, 2)"""


@query("leaderboard_display", BOARD + _MATRIX + """, ag AS (SELECT submission, cell_type, count(DISTINCT cell_slug) AS n_seeds, avg(own_price_bias) AS b, stddev_pop(own_price_bias) AS bs, avg(substitution_error) AS s, stddev_pop(substitution_error) AS ss, avg(forecast_error) AS f, avg(wmape) AS ee, avg(wmpe) AS eb FROM lb JOIN ow USING (submission, cell_slug) GROUP BY 1, 2)
SELECT row_number() OVER (PARTITION BY cell_type ORDER BY abs(b), submission) AS rank, submission, cell_type, 'synthetic' AS data_arm, n_seeds, format('{:.3f} ± {:.3f}', b, bs) AS own_price_bias, format('{:.3f} ± {:.3f}', s, ss) AS substitution_error, format('{:.3f}', f) AS forecast_error, format('{:.3f}', ee) AS elasticity_own_error, format('{:.3f}', eb) AS elasticity_own_bias,
  '' AS actual_forecast_error, '' AS validity_own_sign_frac, '' AS validity_substitution_frac, '' AS validity_range_in_band, '' AS validity_monotonicity_frac FROM ag""")
def leaderboard_display(spark: SparkSession, d: str) -> DataFrame:
    out = board.displayed(board.over_seeds(board.leaderboard(payloads(spark, d))))
    return out.withColumn("rank", F.col("rank").cast("long"))


_CLASSES = ("substitute", "complement", "unrelated")
_OF_CLASS = ", ".join(
    f"round(CASE WHEN tp_{c} > 0 THEN 2.0 * tp_{c} / (2 * tp_{c} + fp_{c} + fn_{c}) WHEN tp_{c} + fp_{c} + fn_{c} > 0 THEN 0.0 END, 8) AS l2_cross_f1_{c}, round(wa_{c}, 8) AS l2_cross_wmape_{c}, round(rm_{c}, 8) AS l2_cross_rmse_{c}, round(wp_{c}, 8) AS l2_cross_wmpe_{c}" for c in _CLASSES
)
_BY_CLASS = ", ".join(
    f"count(*) FILTER (tc = '{c}' AND hc = '{c}') AS tp_{c}, count(*) FILTER (tc <> '{c}' AND hc = '{c}') AS fp_{c}, count(*) FILTER (tc = '{c}' AND hc <> '{c}') AS fn_{c}, sum(w * abs(h - epsilon_star)) FILTER (tc = '{c}') / sum(w * abs(epsilon_star)) FILTER (tc = '{c}') AS wa_{c}, "
    f"sqrt(avg(pow(h - epsilon_star, 2)) FILTER (tc = '{c}')) AS rm_{c}, sum(w * (h - epsilon_star)) FILTER (tc = '{c}') / sum(w * abs(epsilon_star)) FILTER (tc = '{c}') AS wp_{c}"
    for c in _CLASSES
)
_SCORECARD = BOARD + _MATRIX + f""", fp AS (SELECT s.submission, t.cell_slug, t.product_id, sum(predicted_units * CAST(f AS DOUBLE) - true_units) AS se FROM truth t LEFT JOIN pred USING (cell_slug, product_id, store_id, week), subs s GROUP BY 1, 2, 3), fb AS (SELECT submission, cell_slug, sum(w * se) / sum(w * tru) AS bias FROM fp JOIN fs USING (submission, cell_slug, product_id) JOIN weights USING (cell_slug, product_id) GROUP BY 1, 2),
cr AS (SELECT ent.*, lim, CASE WHEN cond > lim THEN 'substitute' WHEN cond < -lim THEN 'complement' ELSE 'unrelated' END AS tc, CASE WHEN h - (epsilon_star - cond) > lim THEN 'substitute' WHEN h - (epsilon_star - cond) < -lim THEN 'complement' ELSE 'unrelated' END AS hc FROM ent JOIN limits USING (cell_slug) WHERE i <> j),
rk AS (SELECT *, row_number() OVER (PARTITION BY submission, cell_slug, affected_product_id ORDER BY abs(h) DESC, priced_product_id) AS a, row_number() OVER (PARTITION BY submission, cell_slug, affected_product_id ORDER BY abs(epsilon_star) DESC, priced_product_id) AS b FROM cr),
gn AS (SELECT submission, cell_slug, affected_product_id, sum(abs(epsilon_star) / log2(a + 1)) AS d, sum(abs(epsilon_star) / log2(b + 1)) AS i, sum(CASE WHEN a <= 5 THEN abs(epsilon_star) / log2(a + 1) ELSE 0 END) AS d5, sum(CASE WHEN b <= 5 THEN abs(epsilon_star) / log2(b + 1) ELSE 0 END) AS i5 FROM rk GROUP BY 1, 2, 3),
nd AS (SELECT submission, cell_slug, avg(CASE WHEN i > 0 THEN d / i END) AS ndcg, avg(CASE WHEN i5 > 0 THEN d5 / i5 END) AS ndcg5 FROM gn GROUP BY 1, 2),
cs AS (SELECT submission, cell_slug, any_value(lim) AS lim, sum(w * abs(h - epsilon_star)) / sum(w * abs(epsilon_star)) AS wa, sqrt(avg(pow(h - epsilon_star, 2))) AS rm, sum(w * (h - epsilon_star)) / sum(w * abs(epsilon_star)) AS wp, avg(h - epsilon_star) AS ms, {_BY_CLASS} FROM cr GROUP BY 1, 2)
SELECT cell_slug AS cell, round(forecast_error, 8) AS l1_demand_wmape, round(bias, 8) AS l1_demand_wmpe, round(sign_accuracy, 8) AS l2_own_sign_accuracy, round(wmape, 8) AS l2_own_wmape, round(rmse, 8) AS l2_own_rmse, round(wmpe, 8) AS l2_own_wmpe, round(mean_signed_error, 8) AS l2_own_mean_signed_error,
  round(ndcg, 8) AS l2_cross_ndcg, round(ndcg5, 8) AS l2_cross_ndcg_at_5, round(wa, 8) AS l2_cross_wmape, round(rm, 8) AS l2_cross_rmse, round(wp, 8) AS l2_cross_wmpe, round(ms, 8) AS l2_cross_mean_signed_error, {_OF_CLASS}, round(lim, 8) AS l2_unrelated_abs_threshold
FROM fe JOIN fb USING (submission, cell_slug) JOIN ow USING (submission, cell_slug) JOIN nd USING (submission, cell_slug) JOIN cs USING (submission, cell_slug)"""


@query("scorecard", _SCORECARD)
def scorecard(spark: SparkSession, d: str) -> DataFrame:
    return rounded(board.scorecard(payloads(spark, d)), 8)


_WAPE = ", ".join(f"round(max(CASE WHEN intervention_id = '{i}' THEN s END), 6) AS \"{i}\"" for i, _, _ in v.SCENARIOS)


@query("scenario_matrix", f""", f AS (SELECT net.*, focal, max(product_id = focal) OVER (PARTITION BY cell_slug, intervention_id, store_id, week) AS carried FROM net JOIN scenmap USING (cell_slug, intervention_id)),
h AS (SELECT cell_slug, intervention_id, any_value(focal) AS focal, sum(abs(net_pred - net_true)) FILTER (carried AND product_id <> focal) AS c, sum(abs(net_true)) FILTER (carried AND product_id <> focal) AS e FROM f GROUP BY 1, 2), w AS (SELECT cell_slug, intervention_id, CASE WHEN focal IS NOT NULL AND e > 1 THEN c / e END AS s FROM h)
SELECT cell_slug AS cell, {_WAPE} FROM w GROUP BY 1""")
def scenario_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(board.scenario_matrix(payloads(spark, d).where("submission_name = 'full'")))


ACTUAL = BOARD + """, sw AS (SELECT subs.submission, cell_slug, product_id, step, units, units * (pow(CAST(step AS DOUBLE), -1.6) - 1) * CAST(f AS DOUBLE) AS dq FROM held, (VALUES (1.1), (0.9)) AS legs(step), subs),
el AS (SELECT submission, cell_slug, product_id, sum(dq) / sum(units) / 0.1 AS e FROM sw WHERE step > 1 GROUP BY 1, 2, 3), rg AS (SELECT submission, cell_slug, avg(CASE WHEN e BETWEEN -3 AND -1 THEN 1.0 ELSE 0.0 END) AS in_band, avg(CASE WHEN e >= 0 THEN 1.0 ELSE 0.0 END) AS wrong FROM el GROUP BY 1, 2),
sg AS (SELECT submission, cell_slug, avg(CASE WHEN dq < 0 THEN 1.0 ELSE 0.0 END) FILTER (step > 1) AS own_sign, avg(CASE WHEN (dq < 0) = (step > 1) THEN 1.0 ELSE 0.0 END) AS mono FROM sw GROUP BY 1, 2)"""


@query("actual_arm", ACTUAL + """ SELECT cell_slug, submission AS submission_name, 'actual' AS data_arm, 'actual' AS family, round(forecast_error, 6) AS demand_wmape, CASE WHEN own_sign < 0.9 THEN 'FAIL' WHEN in_band < 0.8 OR wrong > 0 OR mono < 0.9 THEN 'WARN' ELSE 'PASS' END AS verdict, 'not_applicable_actual_data' AS status FROM fe JOIN rg USING (submission, cell_slug) JOIN sg USING (submission, cell_slug)""")
def actual_arm(spark: SparkSession, d: str) -> DataFrame:
    return actual_payloads(spark, d).select("cell_slug", "submission_name", "data_arm", "family", F.round("sales_forecasting.demand_wmape", 6).alias("demand_wmape"), "validity_checks_actual.gate.verdict", "elasticity_recovery.status")


def actual_payloads(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """The panel scored as real data: each focal's own sweep, with the scenarios' deltas scaled to it."""
    p = v.panel(spark, d) if p is None else p
    sweep = own_price_sweep(p, v.weeks(p))
    moved = sweep.select("cell_slug", "intervention_id", "product_id", "store_id", "week", (F.col("baseline_units") * (F.pow(F.col("intervention_price") / F.col("baseline_price"), F.lit(-1.6)) - 1)).alias("predicted_delta_units"))
    config = p.select("cell_slug").distinct().select("cell_slug", F.lit("test").alias("benchmark_version"), F.lit("log_log").alias("family"))
    keys = config.select("cell_slug").crossJoin(spark.createDataFrame([("full",), ("half",)], "submission_name string"))
    return scoring.evaluate_actual(keys, config, p, v.weeks(p), sweep, _both(v.predictions(p), "predicted_units"), _both(moved, "predicted_delta_units"))
