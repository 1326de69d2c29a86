"""Cells and payloads on disk, and skipped cells."""

import json

import pytest
from pyspark.sql import functions as F

from shelfwise.operators import board
from shelfwise.plans import scoring
from shelfwise.sources import cells, submissions


def make_cell(root, slug, marker, weeks=6):
    config = {"benchmark_version": "v1", "benchmark_family": {"active_cell": {"model_family": "log_log"}}, "simulation": {"counterfactual_eval_weeks": 2}}
    for folder in ("public", "hidden", "release", "reports"):
        (root / slug / folder).mkdir(parents=True)
    (root / slug / marker).write_text(json.dumps(config if "release" in marker else {"config": config}, indent=1))
    lines = ["product_id,store_id,week,units,dollars,price,promo_flag,promo_cost,supply_cost_proxy,extra"] + [f"007,S1,{w},{w},{2 * w},2.0,0,,1.5,x" for w in range(1, weeks + 1)] + ["008,S1,1,junk,,2.0,0,,1.5,x"]
    (root / slug / "hidden/transactions_full_hidden.csv").write_text("\n".join(lines))


def test_cells(spark, tmp_path):
    make_cell(tmp_path, "a_log_log_seed1", cells.MARKERS[0])
    make_cell(tmp_path, "b_log_log_seed2", cells.MARKERS[1])
    root = str(tmp_path)
    assert sorted(r[0] for r in cells.discover(spark, root).collect()) == ["a_log_log_seed1", "b_log_log_seed2"]
    assert [r[0] for r in cells.discover(spark, root, "b_.*").collect()] == ["b_log_log_seed2"]
    config = cells.read_config(spark, root)
    assert {(r.cell_slug, r.family, r.eval_week_count) for r in config.collect()} == {("a_log_log_seed1", "log_log", 2), ("b_log_log_seed2", "log_log", 2)}
    panel = cells.read_table(spark, root, "panel")
    rows = panel.where("cell_slug = 'a_log_log_seed1'").orderBy("row_ord").collect()
    assert len(rows) == 7 and rows[0].product_id == "007" and rows[-1].units is None
    assert sorted((r.cell_slug[0], r.week) for r in cells.eval_weeks(panel, config).collect()) == [("a", 5), ("a", 6), ("b", 5), ("b", 6)]
    truth, sent = panel.select("cell_slug").where("cell_slug like 'a%'"), spark.createDataFrame([("a_log_log_seed1",)], "cell_slug string")
    assert {tuple(r) for r in scoring.skipped(cells.discover(spark, root), truth, sent).collect()} == {("b_log_log_seed2", "no submission subdirectory")}


def test_payloads_and_references(spark, tmp_path):
    one = lambda name, slug, arm, wape: spark.createDataFrame([(name, slug, arm, wape)], "submission_name string, cell_slug string, data_arm string, w double").select("submission_name", "cell_slug", "data_arm", F.struct(F.col("w").alias("demand_wmape")).alias("sales_forecasting"))
    scored = one("mine", "x_seed1", None, 0.5)
    cells.write_payloads(board.conformed(scored), str(tmp_path / "out"))
    back = cells.read_payloads(spark, str(tmp_path / "out"))
    assert back.select("submission_name", "sales_forecasting.demand_wmape").first() == ("mine", 0.5)
    refs = one("same", "x_seed1", "synthetic", 0.4).unionByName(one("other arm", "x_seed1", "actual", 0.3)).unionByName(one("elsewhere", "y_seed1", "actual", 0.2))
    assert {r.submission_name for r in board.with_references(back, refs).collect()} == {"mine", "same", "elsewhere"}
    assert {r.submission_name for r in board.placement(back, refs).collect()} == {"mine", "same", "other arm"}
    assert {(r.submission, r.forecast_error) for r in board.leaderboard(board.with_references(back, refs)).collect()} == {("mine", 0.5), ("same", 0.4), ("elsewhere", None)}


def test_absent_and_bad_tables(spark, tmp_path):
    make_cell(tmp_path / "cells", "a_log_log_seed1", cells.MARKERS[0])
    none = cells.read_table(spark, str(tmp_path / "cells"), "sweep")
    assert none.count() == 0 and none.columns == ["cell_slug", *cells.TABLES["sweep"][1].fieldNames(), "row_ord"]
    for name, text in (("good", "product_id,store_id,week,predicted_units\nP,S,1,2.0"), ("bad", "product_id,store_id\nP,S"), ("blank", "")):
        (tmp_path / "sent" / name / "c").mkdir(parents=True)
        (tmp_path / "sent" / name / "c" / submissions.FILES["forecast"]).write_text(text)
    tables, told = submissions.read_submissions(spark, str(tmp_path / "sent"), [(n, "c") for n in ("good", "bad", "blank")])
    assert {(r.submission_name, r.status) for r in told.where("task = 'forecast'").collect()} == {("good", "ok"), ("bad", "invalid_format"), ("blank", "invalid_format")}
    assert {r.status for r in told.where("task <> 'forecast'").collect()} == {"not_submitted"}
    assert [r.week for r in tables["forecast"].collect()] == [1] and tables["elasticity"].count() == 0
    empty = board.conformed(told.select("submission_name", "cell_slug").distinct())
    marked = {r.submission_name: r.s for r in scoring.with_problems(empty, told).selectExpr("submission_name", "sales_forecasting.status as s").collect()}
    assert marked == {"good": None, "bad": "invalid_format", "blank": "invalid_format"}


def test_columns_by_each_files_own_header(spark, tmp_path):
    """Other orders, further columns, quotes, a byte order mark, blank lines, fields too few and too many, a name with special characters, and a table of parts."""
    sent, file = tmp_path / "sent", submissions.FILES["forecast"]
    texts = {
        ("a b%+", "c 1"): "product_id,store_id,week,predicted_units\n1,S,3,2.5\n\n2,S,junk,junk\nproduct_id,store_id,week,predicted_units\n",
        ("mixed", "c 1"): '\ufeffextra,week,"store_id",predicted_units,product_id\n"x, y",4,"S ""q""",7,007\n,5\n1,2,3,4,5,6,7\n',
        ("short", "c 1"): "product_id,store_id,week\n1,S,3",
    }
    for (name, cell), text in texts.items():
        (sent / name / cell).mkdir(parents=True)
        (sent / name / cell / file).write_text(text, encoding="utf-8")
    (sent / "parts" / "c 1" / file).mkdir(parents=True)
    (sent / "parts" / "c 1" / file / "part-0.csv").write_text("week,product_id,store_id,predicted_units\n1,P,S,1\n")
    (sent / "parts" / "c 1" / file / "part-1.csv").write_text("product_id,store_id,predicted_units,week\nP,S,2,2\n")
    keys = [(n, "c 1") for n in ("a b%+", "mixed", "short", "parts", "none")]
    tables, told = submissions.read_submissions(spark, str(sent), keys)
    got = {}
    for r in tables["forecast"].collect():
        got.setdefault(r.submission_name, set()).add((r.product_id, r.store_id, r.week, r.predicted_units))
    assert got == {
        "a b%+": {("1", "S", 3, "2.5"), ("2", "S", None, "junk"), ("product_id", "store_id", None, "predicted_units")},
        "mixed": {("007", 'S "q"', 4, "7"), (None, None, 5, None), ("5", "3", 2, "4")}, "parts": {("P", "S", 1, "1"), ("P", "S", 2, "2")},
    }
    status = {r.submission_name: (r.status, r.reason) for r in told.where("task = 'forecast'").collect()}
    assert status == {"a b%+": ("ok", None), "mixed": ("ok", None), "parts": ("ok", None), "none": ("not_submitted", None), "short": ("invalid_format", "forecast: no column predicted_units among product_id, store_id, week")}


def test_a_split_file_has_one_header(spark, tmp_path):
    lines = ["product_id,store_id,week,predicted_units", *[f"P{k},S,{k},{k}.5" for k in range(3000)]]
    (tmp_path / "m" / "c").mkdir(parents=True)
    (tmp_path / "m" / "c" / submissions.FILES["forecast"]).write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, told = submissions.read_task(spark, str(tmp_path), "forecast")
        assert spark.read.text(str(tmp_path / "m" / "c")).rdd.getNumPartitions() > 3 and rows.count() == 3000 and rows.agg(F.sum("week")).first()[0] == sum(range(3000)) and told.first().status == "ok"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_submissions_are_one_scan(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('s', id) as submission_name", "'c' as cell_slug", "'P' as product_id", "'S' as store_id", "cast(id as int) as week", "cast(id as double) as predicted_units")
    submissions.write_task(rows.repartition(4), str(tmp_path), "forecast")
    found, told = submissions.read_task(spark, str(tmp_path), "forecast")
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan text") <= 4
    assert {(r.submission_name, r.week) for r in found.collect()} == {(f"s{k}", k) for k in range(300)} and told.where("status = 'ok'").count() == 300


def test_problems_of_cells(spark, tmp_path):
    for k in range(4):
        make_cell(tmp_path, f"x_seed{k}", cells.MARKERS[0])
    panel = cells.TABLES["panel"][0]
    (tmp_path / "x_seed1" / panel).write_text("")
    (tmp_path / "x_seed2" / panel).write_text("store_id,product_id,week,units,price\nS,P,1,2,3\n")
    (tmp_path / "x_seed3" / panel).write_text("price,dollars,units,week,store_id,product_id\n1.5,3,2,7,S,P\n1,1,1,x,S,P\n1,1,1,,S,P\n")
    told = {r.cell_slug: r.reason for r in cells.problems(spark, str(tmp_path), "panel").collect()}
    assert told == {"x_seed1": "panel: an empty file", "x_seed2": "panel: no column dollars", "x_seed3": "panel: 1 rows whose week is no whole number"}
    assert {r.cell_slug for r in cells.having(spark, str(tmp_path), "panel").collect()} == {f"x_seed{k}" for k in range(4)}
    rows = {(r.cell_slug, r.week): (r.product_id, r.price, r.units) for r in cells.read_table(spark, str(tmp_path), "panel").where("cell_slug in ('x_seed2', 'x_seed3')").collect()}
    assert rows == {("x_seed2", 1): ("P", 3.0, 2.0), ("x_seed3", 7): ("P", 1.5, 2.0), ("x_seed3", None): ("P", 1.0, 1.0)}
    assert cells.problems(spark, str(tmp_path), "sweep_truth").count() == 0


def test_a_cell_is_not_written_over(spark, tmp_path):
    rows = spark.createDataFrame([("c=1 %", "P", 1)], "cell_slug string, product_id string, week int")
    cells.write_table(rows, str(tmp_path), "panel")
    assert [(r.cell_slug, r.product_id, r.week) for r in cells.read_table(spark, str(tmp_path), "panel").collect()] == [("c=1 %", "P", 1)]
    with pytest.raises(OSError):
        cells.write_table(rows, str(tmp_path), "panel")


def test_a_failing_cell_leaves_the_others(spark):
    def score(slug):
        if slug == "b":
            raise ValueError("broken")
        return spark.createDataFrame([(slug, "s")], "cell_slug string, submission_name string")

    payloads, failed = scoring.scored_apart(["a", "b", "c"], score)
    assert {r.cell_slug for r in payloads.collect()} == {"a", "c"} and failed == [("b", "scoring error: broken")]


def test_boards_and_fit_meta_on_disk(spark, tmp_path):
    fits = spark.createDataFrame([("iv_text", "c", "P1", True), ("iv_text", "c", "P2", False)], "variant string, cell_slug string, product_id string, converged boolean")
    cells.write_fit_meta(fits, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).select("variant", "cell_slug", "n_products", "n_converged").first() == ("iv_text", "c", 2, 1)
    cells.write_board(fits.drop("converged"), str(tmp_path / "board"))
    assert spark.read.option("header", True).csv(str(tmp_path / "board")).count() == 2
