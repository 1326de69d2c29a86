"""Queries over the scoring operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import bootstrap, counterfactual, elasticity, forecast, validity
from shelfwise.queries import views as v

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = v.SQL + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("revenue_weights", "SELECT cell_slug, product_id, round(w, 6) AS w FROM weights")
def revenue_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(forecast.revenue_weights(v.training(v.panel(spark, d))))


@query("support_pairs", "SELECT * FROM support")
def support_pairs(spark: SparkSession, d: str) -> DataFrame:
    return forecast.support_pairs(v.training(v.panel(spark, d)))


@query("eval_weeks", "SELECT * FROM weeks")
def eval_weeks(spark: SparkSession, d: str) -> DataFrame:
    return v.weeks(v.panel(spark, d))


@query("demand_truth", "SELECT * FROM truth")
def demand_truth(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return forecast.demand_truth(p, v.weeks(p), forecast.support_pairs(v.training(p)))


@query("naive_forecast", """, lastweeks AS (SELECT cell_slug, week FROM (SELECT cell_slug, week, dense_rank() OVER (PARTITION BY cell_slug ORDER BY week DESC) AS p FROM (SELECT DISTINCT cell_slug, week FROM train)) WHERE p <= 8),
m AS (SELECT cell_slug, product_id, store_id, avg(units) AS u FROM train SEMI JOIN lastweeks USING (cell_slug, week) GROUP BY 1, 2, 3)
SELECT cell_slug, product_id, store_id, week, round(coalesce(u, 0.0), 6) AS predicted_units FROM held LEFT JOIN m USING (cell_slug, product_id, store_id)""")
def naive_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(forecast.naive_forecast(v.training(p), v.held_out(p)))


_SCORES = """, j AS (SELECT truth.*, predicted_units FROM truth LEFT JOIN pred USING (cell_slug, product_id, store_id, week)),
e AS (SELECT cell_slug, product_id, sum(abs(predicted_units - true_units)) AS ae, sum(predicted_units - true_units) AS se, sum(CASE WHEN predicted_units IS NOT NULL THEN abs(true_units) END) AS tru, count(predicted_units) AS n, count(*) AS m FROM j GROUP BY 1, 2),
o AS (SELECT cell_slug, count(*) AS ignored FROM pred ANTI JOIN truth USING (cell_slug, product_id, store_id, week) GROUP BY 1)
SELECT cell_slug, round(sum(w * ae) / sum(w * tru), 6) AS demand_wmape, round(sum(w * se) / sum(w * tru), 6) AS demand_wmpe, CAST(sum(m) AS BIGINT) AS n_truth_rows, CAST(sum(n) AS BIGINT) AS n_scored_rows, CAST(sum(m - n) AS BIGINT) AS n_truth_rows_without_prediction,
  coalesce(any_value(ignored), 0) AS n_prediction_rows_ignored_out_of_support, sum(m - n) = 0 AS submission_complete FROM e LEFT JOIN weights USING (cell_slug, product_id) LEFT JOIN o USING (cell_slug) GROUP BY cell_slug"""


@query("demand_scores", _SCORES)
def demand_scores(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    t = v.training(p)
    return rounded(forecast.demand_scores(v.predictions(p), forecast.demand_truth(p, v.weeks(p), forecast.support_pairs(t)), forecast.revenue_weights(t)))


@query("own_price_sweep", """SELECT cell_slug, 'actual_own_sweep_' || product_id || '_' || tag AS intervention_id, product_id, store_id, week, round(price, 6) AS baseline_price, round(price * CAST(step AS DOUBLE), 6) AS intervention_price, units AS baseline_units FROM held, (VALUES ('plus', 1.1), ('minus', 0.9)) AS legs(tag, step)""")
def own_price_sweep(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(counterfactual.own_price_sweep(p, v.weeks(p)))


@query("scenario_map", "SELECT cell_slug, intervention_id, focal, direction FROM scenmap")
def scenario_map(spark: SparkSession, d: str) -> DataFrame:
    return counterfactual.scenario_map(v.scenario_rows(v.panel(spark, d)))


def _frame(p: DataFrame) -> DataFrame:
    return counterfactual.scenario_frame(v.scenario_rows(p), v.deltas(p))


@query("netted_residuals", "SELECT cell_slug, intervention_id, product_id, store_id, week, round(net_true, 10) + 0.0 AS net_dq_true, round(net_pred, 10) + 0.0 AS net_dq_pred FROM net")
def netted_residuals(spark: SparkSession, d: str) -> DataFrame:
    out = counterfactual.netted(_frame(v.panel(spark, d)), ["cell_slug", "intervention_id"])
    return rounded(out.select("cell_slug", "intervention_id", "product_id", "store_id", "week", "net_dq_true", "net_dq_pred"), 10).withColumns({c: F.col(c) + 0.0 for c in ("net_dq_true", "net_dq_pred")})


_HEADLINE = """, f AS (SELECT net.*, focal, product_id = focal AS own, max(product_id = focal) OVER (PARTITION BY cell_slug, intervention_id, store_id, week) AS carried FROM net JOIN scenmap USING (cell_slug, intervention_id)),
h AS (SELECT cell_slug, intervention_id, any_value(focal) AS focal, sum(net_pred - net_true) FILTER (own) AS a, sum(abs(net_true)) FILTER (own) AS b, sum(abs(net_pred - net_true)) FILTER (carried AND NOT own) AS c, sum(abs(net_true)) FILTER (carried AND NOT own) AS e,
  count(DISTINCT (store_id, week)) FILTER (carried AND NOT own) AS n_store_weeks_scored, count(DISTINCT (store_id, week)) FILTER (NOT carried) AS n_store_weeks_focal_missing, count(DISTINCT store_id) FILTER (carried) AS n_stores_focal_carrying, count(DISTINCT store_id) AS n_stores_total,
  count(*) FILTER (unsent) AS n_truth_rows_without_submission, count(*) FILTER (NOT unsent) AS n_submitted_rows FROM f GROUP BY 1, 2)
SELECT cell_slug, intervention_id, focal, CASE WHEN focal IS NULL THEN 'no_focal_in_public_context' ELSE 'scored' END AS status, CASE WHEN focal IS NOT NULL AND b > 1 THEN round(a / b, 6) END AS own_price_wmpe, CASE WHEN focal IS NOT NULL AND e > 1 THEN round(c / e, 6) END AS substitution_wape,
  CASE WHEN focal IS NOT NULL THEN n_store_weeks_scored END AS n_store_weeks_scored, CASE WHEN focal IS NOT NULL THEN n_store_weeks_focal_missing END AS n_store_weeks_focal_missing, CASE WHEN focal IS NOT NULL THEN n_stores_focal_carrying END AS n_stores_focal_carrying, CASE WHEN focal IS NOT NULL THEN n_stores_total END AS n_stores_total,
  n_truth_rows_without_submission, n_submitted_rows, CAST(0 AS BIGINT) AS n_submission_rows_ignored_out_of_support FROM h"""


def _headline(p: DataFrame) -> DataFrame:
    rows = v.scenario_rows(p)
    return counterfactual.score_scenarios(rows, v.deltas(p), rows)


@query("headline_all_scenarios", _HEADLINE)
def headline_all_scenarios(spark: SparkSession, d: str) -> DataFrame:
    out = _headline(v.panel(spark, d))
    return rounded(out.select("cell_slug", "intervention_id", "focal", "status", "own_price_wmpe", "substitution_wape", "n_store_weeks_scored", "n_store_weeks_focal_missing", "n_stores_focal_carrying", "n_stores_total", "n_truth_rows_without_submission", "n_submitted_rows", "n_submission_rows_ignored_out_of_support"))


def _entries(p: DataFrame) -> DataFrame:
    return elasticity.aligned(v.matrix(p), v.matrix_truth(p), forecast.revenue_weights(v.training(p)))


@query("elasticity_counts", """SELECT cell_slug, count(DISTINCT affected_product_id) AS n_products, count(*) FILTER (sent IS NULL AND support) AS n_matrix_entries_missing_in_submission, count(*) FILTER (NOT support) AS n_entries_unsupported_excluded,
  count(*) FILTER ((i + j) % 9 <> 0 AND (i * j) % 17 = 0) AS n_submission_entries_ignored_out_of_matrix, count(*) FILTER (sent IS NOT NULL AND NOT support) AS n_submission_entries_ignored_unsupported, count(*) FILTER (sent IS NULL AND support) = 0 AS submission_complete FROM entries GROUP BY 1""")
def elasticity_counts(spark: SparkSession, d: str) -> DataFrame:
    return elasticity.entry_counts(_entries(v.panel(spark, d)), v.CELL)


_MAG = "round(sum(w * abs(hat - epsilon_star)) / sum(w * abs(epsilon_star)), 6) AS wmape, round(sqrt(avg(pow(hat - epsilon_star, 2))), 6) AS rmse, round(sum(w * (hat - epsilon_star)) / sum(w * abs(epsilon_star)), 6) AS wmpe, round(avg(hat - epsilon_star), 6) AS mean_signed_error, count(*) AS n_entries"


@query("elasticity_own", f", o AS (SELECT *, coalesce(sent, 0.0) AS hat FROM entries WHERE i = j AND support) SELECT cell_slug, round(avg(CASE WHEN sign(hat) = sign(epsilon_star) THEN 1.0 ELSE 0.0 END), 6) AS sign_accuracy, {_MAG} FROM o GROUP BY 1")
def elasticity_own(spark: SparkSession, d: str) -> DataFrame:
    out = elasticity.own_scores(_entries(v.panel(spark, d)), v.CELL)
    return rounded(out.select("cell_slug", "own_price.*").drop("n_diagonal_excluded_unsupported"))


@query("elasticity_by_class", f"SELECT cell_slug, true_class, {_MAG} FROM labels GROUP BY 1, 2")
def elasticity_by_class(spark: SparkSession, d: str) -> DataFrame:
    cross = elasticity.classified(_entries(v.panel(spark, d)), v.CELL)
    return rounded(cross.groupBy("cell_slug", "true_class").agg(elasticity.magnitude().alias("m")).select("cell_slug", "true_class", "m.*"))


@query("cross_f1", """, c AS (SELECT cell_slug, class, count(*) FILTER (true_class = class AND hat_class = class) AS tp, count(*) FILTER (true_class <> class AND hat_class = class) AS fp, count(*) FILTER (true_class = class AND hat_class <> class) AS fn FROM labels, (VALUES ('substitute'), ('complement'), ('unrelated')) AS k(class) GROUP BY 1, 2)
SELECT cell_slug, class, round(CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) WHEN tp + fp + fn > 0 THEN 0.0 END, 6) AS f1, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS "precision", CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, tp + fn AS n_true FROM c""")
def cross_f1(spark: SparkSession, d: str) -> DataFrame:
    return rounded(elasticity.class_scores(elasticity.classified(_entries(v.panel(spark, d)), v.CELL), v.CELL))


def _ndcg_sql(k: int | None) -> str:
    inside = f"<= {k}" if k else "> 0"
    return f""", r AS (SELECT *, row_number() OVER (PARTITION BY cell_slug, affected_product_id ORDER BY abs(hat) DESC, priced_product_id) AS a, row_number() OVER (PARTITION BY cell_slug, affected_product_id ORDER BY abs(epsilon_star) DESC, priced_product_id) AS b FROM cross_entries),
g AS (SELECT cell_slug, affected_product_id, sum(CASE WHEN a {inside} THEN abs(epsilon_star) / log2(a + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b {inside} THEN abs(epsilon_star) / log2(b + 1) ELSE 0 END) AS ideal FROM r GROUP BY 1, 2)
SELECT cell_slug, round(avg(CASE WHEN ideal > 0 THEN dcg / ideal END), 6) AS ndcg FROM g GROUP BY 1"""


@query("ndcg", _ndcg_sql(None))
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(elasticity.ndcg(_entries(v.panel(spark, d)), v.CELL))


@query("ndcg_at_5", _ndcg_sql(5))
def ndcg_at_5(spark: SparkSession, d: str) -> DataFrame:
    return rounded(elasticity.ndcg(_entries(v.panel(spark, d)), v.CELL, 5))


@query("loglog_truth", """, st AS (SELECT DISTINCT cell_slug, store_id, 0.8 + 0.02 * CAST(substr(store_id, 2) AS INTEGER) AS sens FROM panel)
SELECT cell_slug, affected_product_id, priced_product_id, round(avg((pow(1.01, sens * epsilon_star) - 1) / 0.01), 6) AS epsilon_star FROM star JOIN st USING (cell_slug) GROUP BY 1, 2, 3""")
def loglog_truth(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    t = v.matrix_truth(p)
    own = t.where("i = j").select("cell_slug", F.col("affected_product_id").alias("product_id"), F.col("epsilon_star").alias("own_elasticity"))
    cross = t.where("i <> j").select("cell_slug", "priced_product_id", "affected_product_id", F.col("epsilon_star").alias("cross_elasticity"))
    sens = p.select("cell_slug", "store_id").distinct().select("cell_slug", (0.8 + 0.02 * F.substring("store_id", 2, 9).cast("int")).alias("sensitivity"))
    return rounded(elasticity.loglog_truth(own, cross, sens))


@query("elasticity_from_deltas", """, q AS (SELECT cell_slug, product_id, sum(units) AS q FROM held GROUP BY 1, 2), m AS (SELECT cell_slug, product_id AS affected_product_id, focal AS priced_product_id, sum(dq_pred) AS dq FROM frame JOIN scenmap USING (cell_slug, intervention_id) WHERE direction = 1 AND NOT unsent GROUP BY 1, 2, 3)
SELECT m.cell_slug, affected_product_id, priced_product_id, round(dq / (0.1 * q), 6) + 0.0 AS elasticity FROM m JOIN q ON m.cell_slug = q.cell_slug AND affected_product_id = product_id""")
def elasticity_from_deltas(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    up = counterfactual.scenario_map(v.scenario_rows(p)).where("direction = 1")
    moved = v.deltas(p).join(up, ["cell_slug", "intervention_id"]).withColumnRenamed("focal", "priced_product_id")
    out = elasticity.elasticity_from_deltas(moved, v.held_out(p).withColumnRenamed("units", "predicted_units"), step=0.1)
    return rounded(out).withColumn("elasticity", F.col("elasticity") + 0.0)


@query("own_price_sign", """, o AS (SELECT frame.*, focal, direction FROM frame JOIN scenmap USING (cell_slug, intervention_id) WHERE product_id = focal)
SELECT cell_slug, intervention_id, focal, any_value(-direction) AS expected_sign, count(*) AS n_focal_store_weeks, count(*) FILTER (dq_pred <> 0) AS n_evaluated, count(*) FILTER (dq_pred = 0) AS n_ambiguous_zero,
  round(count(*) FILTER (sign(dq_pred) = -direction) / count(*) FILTER (dq_pred <> 0), 6) AS frac_correct_sign, round(count(*) FILTER (dq_pred <> 0 AND sign(dq_pred) <> -direction) / count(*) FILTER (dq_pred <> 0), 6) AS frac_wrong_sign FROM o GROUP BY 1, 2, 3""")
def own_price_sign(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(validity.own_price_sign(_frame(p), counterfactual.scenario_map(v.scenario_rows(p)), ["cell_slug", "intervention_id"]))


@query("substitution_sign", """, c AS (SELECT net.*, focal, CASE WHEN product_id = 'Brand#3' THEN -direction ELSE direction END AS want, direction FROM net JOIN scenmap USING (cell_slug, intervention_id) WHERE product_id <> focal)
SELECT cell_slug, intervention_id, focal, any_value(direction) AS expected_competitor_sign, count(DISTINCT product_id) FILTER (product_id = 'Brand#3') AS n_complements_seen, round(sum(abs(net_pred)) FILTER (sign(net_pred) = want AND abs(net_pred) > 1e-9) / sum(abs(net_pred)) FILTER (abs(net_pred) > 1e-9), 6) AS frac_redistribution_mass_correct,
  round(count(*) FILTER (sign(net_pred) = want AND abs(net_pred) > 1e-9) / count(*) FILTER (abs(net_pred) > 1e-9), 6) AS frac_competitors_correct_count, count(*) FILTER (abs(net_pred) > 1e-9) AS n_competitor_observations_scored, round(sum(abs(net_pred)), 4) AS total_competitor_mass FROM c GROUP BY 1, 2, 3""")
def substitution_sign(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    known = p.where("product_id = 'Brand#3'").select("cell_slug", "product_id").distinct()
    out = validity.substitution_sign(_frame(p), counterfactual.scenario_map(v.scenario_rows(p)), ["cell_slug", "intervention_id"], known, 1e-9)
    return rounded(out).withColumn("total_competitor_mass", F.round("total_competitor_mass", 4))


@query("own_range", "SELECT cell_slug, count(sent) AS n_products, round(avg(CASE WHEN sent BETWEEN -2 AND -1.5 THEN 1.0 WHEN sent IS NOT NULL THEN 0.0 END), 6) AS frac_in_band, round(avg(CASE WHEN sent < 0 THEN 1.0 WHEN sent >= 0 THEN 0.0 END), 6) AS frac_correct_sign, round(avg(CASE WHEN sent >= 0 THEN 1.0 WHEN sent < 0 THEN 0.0 END), 6) AS frac_wrong_sign, round(avg(CASE WHEN abs(sent) > 2.2 THEN 1.0 WHEN sent IS NOT NULL THEN 0.0 END), 6) AS frac_extreme FROM entries WHERE i = j GROUP BY 1")
def own_range(spark: SparkSession, d: str) -> DataFrame:
    own = v.matrix(v.panel(spark, d)).where("affected_product_id = priced_product_id")
    return rounded(validity.own_range(own, v.CELL, (-2.0, -1.5), 2.2))


@query("cross_plausibility", """, s AS (SELECT cell_slug, affected_product_id, CASE WHEN (i * j) % 17 = 0 THEN 'Y' || priced_product_id ELSE priced_product_id END AS p, epsilon_star * (1 + ((i + j) % 5 - 2) / 10.0) AS e FROM star WHERE (i + j) % 9 <> 0), o AS (SELECT cell_slug, p, e AS own FROM s WHERE affected_product_id = p)
SELECT cell_slug, count(*) AS n_cross_entries, round(avg(CASE WHEN abs(e) > 0.08 THEN 1.0 ELSE 0.0 END), 6) AS frac_cross_extreme, round(avg(CASE WHEN abs(own) > 0 THEN CASE WHEN abs(e) >= abs(own) THEN 1.0 ELSE 0.0 END END), 6) AS frac_cross_exceeds_own, round(avg(CASE WHEN sign(e) = 1 THEN 1.0 ELSE 0.0 END), 6) AS frac_cross_matches_prior FROM s LEFT JOIN o USING (cell_slug, p) WHERE affected_product_id <> p GROUP BY 1""")
def cross_plausibility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(validity.cross_plausibility(v.matrix(v.panel(spark, d)), v.CELL, 0.08, 1))


_MONO = """, o AS (SELECT frame.*, focal, direction FROM frame JOIN scenmap USING (cell_slug, intervention_id) WHERE product_id = focal),
mono AS (SELECT u.cell_slug, u.focal, count(*) AS n_store_weeks, avg(CASE WHEN u.dq_pred < 0 AND x.dq_pred > 0 THEN 1.0 ELSE 0.0 END) AS frac_consistent FROM o u JOIN o x ON u.cell_slug = x.cell_slug AND u.focal = x.focal AND u.store_id = x.store_id AND u.week = x.week AND u.direction = 1 AND x.direction = -1 GROUP BY 1, 2)"""


@query("monotonicity", _MONO + " SELECT cell_slug, focal, n_store_weeks, round(frac_consistent, 6) AS frac_consistent FROM mono")
def monotonicity(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(validity.monotonicity(_frame(p), counterfactual.scenario_map(v.scenario_rows(p))))


_DERIVED = """, leg AS (SELECT f.cell_slug, focal, direction, sum(baseline_units) AS base, sum(dq_pred) AS dq, min_by((intervention_price - baseline_price) / baseline_price, row_ord) AS pct FROM frame f JOIN scenmap m USING (cell_slug, intervention_id) WHERE product_id = focal GROUP BY 1, 2, 3),
eps AS (SELECT cell_slug, focal AS product_id, max_by(dq / base / pct, direction) AS elasticity FROM leg GROUP BY 1, 2)"""


@query("derived_elasticity", _DERIVED + " SELECT cell_slug, product_id, round(elasticity, 6) AS elasticity FROM eps")
def derived_elasticity(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    rows = v.scenario_rows(p)
    return rounded(validity.derived_elasticities(validity.sweep_frame(rows, v.deltas(p)), counterfactual.scenario_map(rows)))


_VALIDITY = _MONO + _DERIVED + """, chosen AS (SELECT * FROM scenmap WHERE direction IS NOT NULL QUALIFY direction = max(direction) OVER (PARTITION BY cell_slug, focal)),
os AS (SELECT cell_slug, sum(g) / sum(k) AS own_price_sign FROM (SELECT f.cell_slug, f.intervention_id, count(*) FILTER (sign(dq_pred) = -direction) AS g, count(*) FILTER (dq_pred <> 0) AS k FROM frame f JOIN chosen c USING (cell_slug, intervention_id) WHERE product_id = focal GROUP BY 1, 2) GROUP BY 1),
ss AS (SELECT cell_slug, sum(a / m * m) / sum(m) AS substitution_mass, sum(g) / sum(k) AS substitution_count FROM (SELECT t.cell_slug, t.intervention_id, sum(abs(net_pred)) FILTER (sign(net_pred) = direction) AS a, sum(abs(net_pred)) AS m, count(*) FILTER (sign(net_pred) = direction) AS g, count(*) FILTER (net_pred <> 0) AS k FROM net t JOIN chosen c USING (cell_slug, intervention_id) WHERE product_id <> focal GROUP BY 1, 2) GROUP BY 1),
rg AS (SELECT cell_slug, count(elasticity) AS n_products, avg(CASE WHEN elasticity BETWEEN -3 AND -1 THEN 1.0 ELSE 0.0 END) AS frac_in_band, avg(CASE WHEN elasticity >= 0 THEN 1.0 ELSE 0.0 END) AS frac_wrong_sign FROM eps GROUP BY 1),
mm AS (SELECT cell_slug, sum(frac_consistent * n_store_weeks) / sum(n_store_weeks) AS monotonicity FROM mono GROUP BY 1)
SELECT cell_slug, n_products, round(own_price_sign, 6) AS own_price_sign, round(substitution_mass, 4) AS substitution_mass, round(frac_in_band, 6) AS frac_in_band, round(monotonicity, 6) AS monotonicity,
  CASE WHEN own_price_sign < 0.9 THEN 'FAIL' WHEN substitution_mass < 0.55 OR frac_in_band < 0.8 OR frac_wrong_sign > 0 OR monotonicity < 0.9 THEN 'WARN' ELSE 'PASS' END AS verdict FROM os JOIN ss USING (cell_slug) JOIN rg USING (cell_slug) JOIN mm USING (cell_slug)"""


@query("validity_gate", _VALIDITY)
def validity_gate(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    out = validity.score_validity(v.scenario_rows(p), v.deltas(p))
    return rounded(out.select("cell_slug", "n_products", "own_price_sign", F.round("substitution_mass", 4).alias("substitution_mass"), "frac_in_band", "monotonicity", "gate.verdict"))


_CHECKS = _MONO + """, ow AS (SELECT cell_slug, intervention_id, focal, count(*) FILTER (sign(dq_pred) = -direction) / count(*) FILTER (dq_pred <> 0) AS own_sign, count(*) FILTER (dq_pred <> 0) AS n_evaluated FROM o GROUP BY 1, 2, 3),
sb AS (SELECT t.cell_slug, t.intervention_id, sum(abs(net_pred)) FILTER (sign(net_pred) = direction AND abs(net_pred) > 1e-9) / sum(abs(net_pred)) FILTER (abs(net_pred) > 1e-9) AS mass FROM net t JOIN scenmap USING (cell_slug, intervention_id) WHERE product_id <> focal GROUP BY 1, 2),
rg AS (SELECT cell_slug, avg(CASE WHEN sent BETWEEN -5 AND -0.2 THEN 1.0 WHEN sent IS NOT NULL THEN 0.0 END) AS in_band, avg(CASE WHEN sent >= 0 THEN 1.0 WHEN sent < 0 THEN 0.0 END) AS wrong FROM entries WHERE i = j GROUP BY 1)
SELECT cell_slug, intervention_id, ow.focal, round(own_sign, 6) AS own_price_sign, n_evaluated, round(mass, 5) AS substitution_mass, round(in_band, 6) AS frac_in_band, round(frac_consistent, 6) AS monotonicity,
  CASE WHEN own_sign < 0.9 THEN 'FAIL' WHEN mass < 0.55 OR in_band < 0.8 OR wrong > 0 OR frac_consistent < 0.9 THEN 'WARN' ELSE 'PASS' END AS verdict FROM ow LEFT JOIN sb USING (cell_slug, intervention_id) JOIN rg USING (cell_slug) LEFT JOIN mono ON mono.cell_slug = ow.cell_slug AND mono.focal = ow.focal"""


@query("scenario_checks", _CHECKS.replace("SELECT cell_slug, intervention_id, ow.focal", "SELECT ow.cell_slug, intervention_id, ow.focal"))
def scenario_checks(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    out = validity.scenario_checks(v.scenario_rows(p), v.deltas(p), elasticities=v.matrix(p), resid_tol=1e-9)
    return rounded(out.select("cell_slug", "intervention_id", "focal", "own_price_sign", "n_evaluated", F.round("substitution_mass", 5).alias("substitution_mass"), "frac_in_band", "monotonicity", "gate.verdict"))


_POISSON = " + ".join(f"(CASE WHEN u >= {p!r} THEN 1 ELSE 0 END)" for p in bootstrap.POISSON)


@query("bootstrap_in_band", f""", own AS (SELECT cell_slug, affected_product_id, CASE WHEN sent BETWEEN -2.0 AND -1.5 THEN 1.0 ELSE 0.0 END AS x FROM entries WHERE i = j AND sent IS NOT NULL),
hashed AS (SELECT *, CAST('0x' || substr(md5(cell_slug || '|' || affected_product_id || '|0'), 1, 13) AS HUGEINT) AS h FROM own), reps AS (SELECT b, CAST('0x' || substr(md5('0|' || b), 1, 13) AS BIGINT) | 1 AS m FROM range(1, 1001) AS r(b)),
draws AS (SELECT cell_slug, x, b, CAST((h * m) % 4503599627370496 AS BIGINT) / 4503599627370496.0 AS u FROM hashed, reps),
st AS (SELECT cell_slug, b, sum(({_POISSON}) * x) / nullif(sum({_POISSON}), 0) AS s FROM draws GROUP BY 1, 2)
SELECT cell_slug, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, 1000 AS n_boot FROM st WHERE s IS NOT NULL GROUP BY 1""")
def bootstrap_in_band(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the share of own elasticities within the band."""
    own = v.matrix(v.panel(spark, d)).where("affected_product_id = priced_product_id").withColumn("ok", F.col("elasticity").between(-2.0, -1.5).cast("int"))
    return rounded(bootstrap.fraction_interval(own, v.CELL, ["cell_slug", "affected_product_id"], "ok"))
