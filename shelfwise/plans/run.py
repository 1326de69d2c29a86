"""A scoring run over files from end to end: cells and submissions are found, read, checked and scored in one job, and whatever isn't scored is a row that says why."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators.board import conformed
from shelfwise.plans.scoring import evaluate, skipped, with_problems
from shelfwise.sources import cells
from shelfwise.sources.submissions import read_submissions, read_task
from shelfwise.staging import fewer_files, staged


class Run(NamedTuple):
    #: A payload for each submission and cell that was scored.
    payloads: DataFrame
    #: (submission_name, cell_slug, task, status, reason) of each submitted table.
    statuses: DataFrame
    #: (cell_slug, reason) of cells that weren't scored.
    skipped: DataFrame


def broken(found: DataFrame, config: DataFrame, weeks: DataFrame, bad: DataFrame) -> DataFrame:
    """(cell_slug, reason) of cells that can't be scored although they have truth and submissions: no evaluation weeks, or what ``cells.problems`` says."""
    counted = weeks.select("cell_slug").distinct().withColumn("has_weeks", F.lit(True))
    each = found.join(config.select("cell_slug", "eval_week_count"), "cell_slug", "left").join(counted, "cell_slug", "left")
    no_weeks = each.where("has_weeks is null").select("cell_slug", F.when(F.coalesce("eval_week_count", F.lit(0)) < 1, "no evaluation weeks in the configuration").otherwise("panel: no rows with a week").alias("reason"))
    every = no_weeks.unionByName(bad.join(found, "cell_slug", "left_semi"))
    return every.groupBy("cell_slug").agg(F.concat(F.lit("scoring error: "), F.array_join(F.sort_array(F.collect_set("reason")), "; ")).alias("reason"))


def score_files(spark: SparkSession, cells_root: str, submissions_root: str, pattern: str | None = None) -> Run:
    """All submissions (folders of ``submissions_root``, with a folder for each cell) on all cells of ``cells_root``.

    A broken cell is left out of every table before anything is scored, so it can't sink the others."""
    found = staged(cells.discover(spark, cells_root, pattern), "cells")
    config = staged(cells.read_config(spark, cells_root), "config")
    sent = reduce(DataFrame.unionByName, [read_task(spark, submissions_root, task)[1].select("submission_name", "cell_slug") for task in ("forecast", "elasticity", "counterfactual")])
    sent = staged(sent.distinct().join(found, "cell_slug", "left_semi"), "sent")
    panel = staged(fewer_files(cells.read_table(spark, cells_root, "panel")), "panel")
    weeks = cells.eval_weeks(panel, config)
    bad = reduce(DataFrame.unionByName, [cells.problems(spark, cells_root, table) for table in cells.NEEDED])
    left = skipped(found, cells.having(spark, cells_root, "panel"), sent)
    failed = broken(found.join(left, "cell_slug", "left_anti"), config, weeks, bad)
    out = staged(left.unionByName(failed), "skipped")
    keys = staged(sent.join(out, "cell_slug", "left_anti").select("cell_slug", "submission_name"), "keys")
    good = lambda df: df.join(keys.select("cell_slug").distinct(), "cell_slug", "left_semi")
    tables, told = read_submissions(spark, submissions_root, keys)
    told = staged(told, "statuses")
    tables = {task: staged(fewer_files(rows), task) for task, rows in tables.items()}
    truth = staged(good(cells.read_table(spark, cells_root, "elasticity_truth")), "truth")
    sweep, context = (staged(fewer_files(good(cells.read_table(spark, cells_root, name))), name) for name in ("sweep_truth", "sweep"))
    scored = evaluate(keys, config, good(panel), good(weeks), truth, sweep, context, tables["forecast"], tables["elasticity"], tables["counterfactual"])
    return Run(staged(conformed(with_problems(scored, told)), "payloads"), told, out)
