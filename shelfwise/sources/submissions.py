"""Submission tables: all files of a task in one scan, header and content checks that end in a status, never in a failed job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.sources.delimited import decoded, placed, scan

#: Columns and file of each task's table.
REQUIRED = {
    "forecast": ("product_id", "store_id", "week", "predicted_units"),
    "elasticity": ("affected_product_id", "priced_product_id", "elasticity"),
    "counterfactual": ("intervention_id", "product_id", "store_id", "week", "predicted_delta_units"),
}
FILES = {"forecast": "forecast_predictions.csv", "elasticity": "elasticity_matrix.csv", "counterfactual": "counterfactual_deltas.csv"}
KEYS = ("submission_name", "cell_slug")
STATUS = "submission_name string, cell_slug string, task string, status string, reason string"


class BadTable(ValueError):
    """A submission table that can't be scored; the message says why."""


def checked(df: DataFrame, task: str) -> DataFrame:
    """Of a table that has been read already: the required columns, ids as text and week as a whole number; raises BadTable if a column is missing."""
    missing = [c for c in REQUIRED[task] if c not in df.columns]
    if missing:
        raise BadTable(f"{task}: no column {', '.join(missing)} among {', '.join(df.columns) or 'none'}")
    keep = [c for c in KEYS if c in df.columns]
    cast = lambda c: F.col(c).try_cast("int") if c == "week" else F.col(c).cast("string") if c.endswith("_id") else F.col(c)
    return df.select(*keep, *[cast(c).alias(c) for c in REQUIRED[task]])


def read_task(spark: SparkSession, root: str, task: str, where: str = "*/*") -> tuple[DataFrame, DataFrame]:
    """(rows of all tables that have the task's columns; ``submission_name, cell_slug, status, reason`` of each table that is there), from ``root``/submission/cell.

    A table of several part files is bad if one of them is. Ids and measures stay text until they are scored, so that junk can be told from nothing."""
    file, wanted = FILES[task], REQUIRED[task]
    at = f"([^/]+)/([^/]+)/{file.replace('.', '[.]')}(?:/[^/]*)?$"
    found = scan(spark, f"{root}/{where}/{file}", wanted, lambda path: [decoded(F.regexp_extract(path, at, k)).alias(c) for k, c in enumerate(KEYS, 1)])
    if found is None:
        types = ", ".join(f"{c} {'int' if c == 'week' else 'string'}" for c in wanted)
        return spark.createDataFrame([], f"submission_name string, cell_slug string, {types}"), spark.createDataFrame([], "submission_name string, cell_slug string, status string, reason string")
    reason = F.when(F.col("missing").isNull(), F.lit(f"{task}: an empty file")).when(F.size("missing") > 0, F.concat(F.lit(f"{task}: no column "), F.array_join("missing", ", "), F.lit(" among "), F.array_join(F.filter("names", lambda c: c != ""), ", ")))
    told = found.files.groupBy(*KEYS).agg(F.min(reason).alias("reason")).select(*KEYS, F.when(F.col("reason").isNull(), "ok").otherwise("invalid_format").alias("status"), "reason")
    rows = found.lines.join(told.where("status = 'ok'").select(*KEYS), list(KEYS), "left_semi")
    return rows.select(*KEYS, *[(found.column(c).try_cast("int") if c == "week" else found.column(c)).alias(c) for c in wanted]), told


def read_submissions(spark: SparkSession, root: str, keys: DataFrame | Iterable[tuple[str, str]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables of all submissions by task, and a row of STATUS for each (submission, cell) of ``keys`` and task: ``ok``, ``not_submitted`` or ``invalid_format`` with its reason.

    One scan for each task, however many submissions there are; tables of other submissions and cells are left out, and a bad file leaves the others alone."""
    keys = keys.select(*KEYS).distinct() if isinstance(keys, DataFrame) else spark.createDataFrame(sorted(set(keys)), "submission_name string, cell_slug string")
    tables, told = {}, None
    for task in FILES:
        rows, status = read_task(spark, root, task)
        tables[task] = rows.join(keys, list(KEYS), "left_semi")
        own = keys.join(status, list(KEYS), "left").select(*KEYS, F.lit(task).alias("task"), F.coalesce("status", F.lit("not_submitted")).alias("status"), "reason")
        told = own if told is None else told.unionByName(own)
    return tables, told


def write_task(rows: DataFrame, root: str, task: str) -> None:
    """The task's tables of all submissions and cells, to root/submission/cell."""
    placed(rows, KEYS, root, FILES[task], lambda w, to: w.option("header", True).option("escape", '"').csv(to))


def duplicate_entries(elasticity: DataFrame) -> DataFrame:
    """(keys, n_duplicates) of matrices with an entry twice; these aren't scored but reported as ``invalid_format``."""
    keys = [c for c in KEYS if c in elasticity.columns]
    each = elasticity.groupBy(*keys, "affected_product_id", "priced_product_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_duplicates"))
