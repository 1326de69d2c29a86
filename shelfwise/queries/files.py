"""Queries over files: cells, submissions, movement files and payloads are written from the given tables and read back as a run finds them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import board
from shelfwise.plans import grid, run, scoring
from shelfwise.queries import panels
from shelfwise.queries import views as v
from shelfwise.queries.board import ACTUAL, BOARD, actual_payloads, payloads
from shelfwise.queries.board import ORACLES as BOARD_ORACLES
from shelfwise.queries.scoring import rounded
from shelfwise.sources import cells, submissions
from shelfwise.sources.movement import clean_movement, read_movement
from shelfwise.staging import shared_folder, staged

QUERIES, ORACLES = {}, {}
_LEADERS = v.SQL + BOARD
_BOTH_ARMS = v.SQL + ACTUAL + """, every AS (
SELECT CASE submission WHEN 'full' THEN 'full' ELSE 'reference' END AS submission, 'log_log' AS kind, cell_slug, 'synthetic' AS data_arm, own_price_bias, forecast_error, CAST(NULL AS DOUBLE) AS actual_forecast_error, CAST(NULL AS DOUBLE) AS validity_own_sign_frac, CAST(NULL AS VARCHAR) AS validity_gate_verdict FROM lb
UNION ALL SELECT submission, cell_slug, cell_slug || '_real', 'actual', NULL, NULL, forecast_error, own_sign, CASE WHEN own_sign < 0.9 THEN 'FAIL' WHEN in_band < 0.8 OR wrong > 0 OR mono < 0.9 THEN 'WARN' ELSE 'PASS' END
  FROM fe JOIN rg USING (submission, cell_slug) JOIN sg USING (submission, cell_slug) WHERE submission = 'full')
SELECT row_number() OVER (PARTITION BY kind, data_arm ORDER BY abs(own_price_bias), submission) AS rank, submission, cell_slug, data_arm, round(own_price_bias, 6) AS own_price_bias, round(forecast_error, 6) AS forecast_error, round(actual_forecast_error, 6) AS actual_forecast_error, round(validity_own_sign_frac, 6) AS validity_own_sign_frac, validity_gate_verdict FROM every"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query("cells_on_disk", v.SQL + """, sw AS (SELECT cell_slug, count(*) AS n FROM scen GROUP BY 1) SELECT cell_slug, 'v1' AS benchmark_version, 'log_log' AS family, count(*) AS panel_rows, round(sum(units), 4) AS units, count(*) FILTER (w.week IS NOT NULL) AS held_out_rows, any_value(n) AS sweep_rows, CAST(0 AS BIGINT) AS store_rows
FROM panel LEFT JOIN weeks w USING (cell_slug, week) JOIN sw USING (cell_slug) GROUP BY 1""")
def cells_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """Panel, sweep and configuration of all cells, each read in one scan; a table that no cell has gives no rows."""
    root, p = _folder(spark), v.panel(spark, d)
    cells.write_table(p, root, "panel")
    cells.write_table(v.scenario_rows(p), root, "sweep")
    cells.write_config(p.select("cell_slug").distinct().select("cell_slug", F.lit("v1").alias("benchmark_version"), F.lit("log_log").alias("family"), F.lit(v.EVAL_WEEKS).alias("eval_week_count")), root)
    found, config, panel = cells.discover(spark, root, "log_log_.*"), cells.read_config(spark, root), cells.read_table(spark, root, "panel")
    held = cells.eval_weeks(panel, config).withColumn("held", F.lit(True))
    count = lambda name, table: cells.read_table(spark, root, table).groupBy("cell_slug").agg(F.count(F.lit(1)).alias(name))
    each = panel.join(held, ["cell_slug", "week"], "left").groupBy("cell_slug").agg(F.count(F.lit(1)).alias("panel_rows"), F.round(F.sum("units"), 4).alias("units"), F.count_if("held").alias("held_out_rows"))
    out = found.join(config.drop("eval_week_count"), "cell_slug").join(each, "cell_slug").join(count("sweep_rows", "sweep"), "cell_slug").join(count("store_rows", "stores"), "cell_slug", "left")
    return out.fillna({"store_rows": 0})


def _send(root: str, name: str, **tables: DataFrame) -> None:
    for task, rows in tables.items():
        submissions.write_task(rows.withColumn("submission_name", F.lit(name)), root, task)


@query("submission_files", v.SQL + """, names(submission_name, task, status) AS (VALUES ('full', 'forecast', 'ok'), ('full', 'elasticity', 'ok'), ('full', 'counterfactual', 'not_submitted'), ('half', 'forecast', 'invalid_format'), ('half', 'elasticity', 'not_submitted'), ('half', 'counterfactual', 'not_submitted')),
n AS (SELECT cell_slug, 'forecast' AS task, count(*) AS n FROM pred GROUP BY 1 UNION ALL SELECT cell_slug, 'elasticity', count(*) FILTER ((i + j) % 9 <> 0) FROM star GROUP BY 1)
SELECT submission_name, cell_slug, task, status, CASE WHEN status = 'ok' THEN n ELSE 0 END AS n_rows FROM names CROSS JOIN (SELECT DISTINCT cell_slug FROM panel) c LEFT JOIN n USING (cell_slug, task)""")
def submission_files(spark: SparkSession, d: str) -> DataFrame:
    """Statuses and rows of submission files: one submission without deltas, one whose forecast has no predictions."""
    root, p = _folder(spark), v.panel(spark, d)
    _send(root, "full", forecast=v.predictions(p), elasticity=v.matrix(p))
    _send(root, "half", forecast=v.predictions(p).drop("predicted_units"))
    keys = p.select("cell_slug").distinct().crossJoin(spark.createDataFrame([("full",), ("half",)], "submission_name string"))
    tables, told = submissions.read_submissions(spark, root, keys)
    parts = None
    for task, table in tables.items():
        own = table.groupBy("submission_name", "cell_slug").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("task", F.lit(task))
        parts = own if parts is None else parts.unionByName(own)
    return told.drop("reason").join(parts, ["submission_name", "cell_slug", "task"], "left").fillna({"n_rows": 0})


_RUN = _LEADERS + """ SELECT 'log_log_seed1' AS cell_slug, s AS submission_name, 'scored' AS outcome, '' AS reason, 'invalid_format' AS forecast_status, 'not_submitted' AS matrix_status, 'not_submitted' AS scenario_status, CAST(NULL AS DOUBLE) AS forecast_error, CAST(NULL AS DOUBLE) AS own_price_bias, CAST(NULL AS DOUBLE) AS substitution_error FROM (VALUES ('half')) h(s)
UNION ALL SELECT cell_slug, 'full', 'scored', '', 'scored', 'scored', 'scored', round(forecast_error, 6), round(own_price_bias, 6), round(substitution_error, 6) FROM lb WHERE submission = 'full' AND cell_slug = 'log_log_seed1'
UNION ALL SELECT c, '', 'skipped', r, '', '', '', NULL, NULL, NULL FROM (VALUES ('log_log_seed2', 'scoring error: panel: 2 rows whose week is no whole number'), ('log_log_seed3', 'hidden truth absent (eval cell?)'), ('log_log_seed4', 'no submission subdirectory'), ('log_log_seed5', 'scoring error: no evaluation weeks in the configuration; panel: no column units'),
  ('log_log_seed6', 'scoring error: elasticity_truth: an empty file; panel: no rows with a week')) x(c, r)"""


def _sent_cells(p: DataFrame, root: str, sent: str) -> None:
    """Six cells: one that is whole, one with junk among its weeks, one without truth, one that nobody sent anything for, one whose configuration and columns lack something, one of empty files."""
    spark = p.sparkSession
    whole = p.where("cell_slug = 'log_log_seed1'")
    as_cell = lambda df, k: df.withColumn("cell_slug", F.lit(f"log_log_seed{k}"))
    junk = p.where("cell_slug = 'log_log_seed2'").withColumn("week", F.col("week").cast("string"))
    junk = junk.unionByName(spark.createDataFrame([("log_log_seed2", "P", "S", w) for w in ("soon", "1.5")], "cell_slug string, product_id string, store_id string, week string"), allowMissingColumns=True)
    for rows in (whole, junk, as_cell(whole, 4), as_cell(whole, 5).drop("units")):
        cells.write_table(rows, root, "panel")
    scenes = v.scenario_rows(whole)
    cells.write_table(scenes, root, "sweep_truth")
    cells.write_table(scenes, root, "sweep")
    cells.write_table(v.matrix_truth(whole), root, "elasticity_truth")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{root}/log_log_seed6/hidden/elasticity_truth_hidden.csv")
    spark.createDataFrame([("product_id,store_id,week,units,dollars,price",)], "value string").coalesce(1).write.text(f"{root}/log_log_seed6/hidden/transactions_full_hidden.csv")
    release = spark.createDataFrame([(f"log_log_seed{k}", None if k == 5 else v.EVAL_WEEKS) for k in range(1, 7)], "cell_slug string, eval_week_count int")
    cells.write_config(release.select("cell_slug", F.lit("v1").alias("benchmark_version"), F.lit("log_log").alias("family"), "eval_week_count"), root)
    mine, matrix, deltas = v.predictions(whole), v.matrix(whole), v.deltas(whole)
    every = mine
    for k in (2, 3, 5, 6, 9):
        every = every.unionByName(as_cell(mine, k))
    _send(sent, "full", forecast=every, elasticity=matrix, counterfactual=deltas)
    _send(sent, "half", forecast=mine.drop("predicted_units"))


@query("scoring_run", _RUN)
def scoring_run(spark: SparkSession, d: str) -> DataFrame:
    """A run over files: one of six cells can be scored, one of two submissions has a bad table; nothing stops the run, and each gap has its reason."""
    root, sent = _folder(spark), _folder(spark)
    _sent_cells(v.panel(spark, d), root, sent)
    done = run.score_files(spark, root, sent, "log_log_.*")
    none = F.lit(None).cast("double")
    status = {"sales_forecasting": "forecast_status", "elasticity_recovery": "matrix_status", "counterfactual_prediction": "scenario_status"}
    lb = board.leaderboard(done.payloads).select("cell_slug", F.col("submission").alias("submission_name"), "forecast_error", "own_price_bias", "substitution_error")
    scored = done.payloads.select("cell_slug", "submission_name", F.lit("scored").alias("outcome"), F.lit("").alias("reason"), *[F.col(f"{block}.status").alias(name) for block, name in status.items()]).join(lb, ["cell_slug", "submission_name"])
    left = done.skipped.select("cell_slug", F.lit("").alias("submission_name"), F.lit("skipped").alias("outcome"), "reason", *[F.lit("").alias(n) for n in status.values()], *[none.alias(c) for c in ("forecast_error", "own_price_bias", "substitution_error")])
    return rounded(scored.unionByName(left))


@query("board_of_both_arms", _BOTH_ARMS)
def board_of_both_arms(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic and actual payloads with reference payloads beside them: ranks restart for each arm, and a reference of a cell that is only scored in the other arm stays out."""
    p = v.panel(spark, d)
    scored, actual = (staged(board.conformed(of(spark, d, p)), "payloads") for of in (payloads, actual_payloads))
    own = scored.where("submission_name = 'full'").unionByName(actual.where("submission_name = 'full'").withColumn("cell_slug", F.concat("cell_slug", F.lit("_real"))))
    half = scored.where("submission_name = 'half'").withColumn("submission_name", F.lit("reference"))
    elsewhere = half.withColumns({"cell_slug": F.concat("cell_slug", F.lit("_real")), "submission_name": F.lit("other arm")})
    out = board.leaderboard(board.with_references(own, half.unionByName(elsewhere)))
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "submission", "cell_slug", "data_arm", "own_price_bias", "forecast_error", "actual_forecast_error", "validity_own_sign_frac", "validity_gate_verdict"))


@query("movement_file", panels.ORACLES["movement_clean"])
def movement_file(spark: SparkSession, d: str) -> DataFrame:
    """The movement table as a file of its category, read back and cleaned."""
    root = _folder(spark)
    v.movement(spark, d).write.option("header", True).csv(f"{root}/Wall.CSV")
    return rounded(clean_movement(read_movement(spark, root, "all")), 10).withColumn("dollars", F.round("dollars", 8))


@query("payloads_on_disk", BOARD_ORACLES["leaderboard"])
def payloads_on_disk(spark: SparkSession, d: str) -> DataFrame:
    """The leaderboard of payloads that were written, one folder for each submission and cell, and read back."""
    path = _folder(spark)
    cells.write_payloads(board.conformed(payloads(spark, d)), path)
    out = board.leaderboard(cells.read_payloads(spark, path))
    return rounded(out.select(F.col("rank").cast("long").alias("rank"), "submission", "cell_type", "cell_slug", "data_arm", "own_price_bias", "substitution_error", "forecast_error"))


@query("skipped_cells", v.SQL + " SELECT DISTINCT cell_slug, CASE WHEN cell_slug LIKE '%1' THEN 'no submission subdirectory' ELSE 'hidden truth absent (eval cell?)' END AS reason FROM panel")
def skipped_cells(spark: SparkSession, d: str) -> DataFrame:
    found = v.panel(spark, d).select("cell_slug").distinct()
    return scoring.skipped(found, found.limit(0), found.where("cell_slug not like '%1'"))


@query("variant_grid")
def variant_grid(spark: SparkSession, d: str) -> DataFrame:
    """All four variants on all cells: what each fit was like, and its coefficients."""
    p = v.panel(spark, d)
    return grid.fit_grid(v.training(p), v.products(spark, d, p))[0]
