"""Arrow batch bounds, ids on their way through pandas, and names of helper columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.staging import discard, fewer_files, staged

__all__ = ["bound_batches", "discard", "fewer_files", "free_name", "hidden_prefix", "id_columns", "ids", "partitions", "release_shuffles", "staged"]

#: Rows and bytes that one Arrow batch may hold on its way to a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, for texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends; for operators of several queries, with staged tables between them."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def id_columns(doc_id: Column) -> list[Column]:
    """A document's id for a trip through pandas, which has no null whole numbers: 0 and ``no_id`` stand for null."""
    doc_id = doc_id.cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id")]


def ids(batch: pd.DataFrame) -> list[int | None]:
    return [None if none else doc for doc, none in zip(batch["doc_id"].tolist(), batch["no_id"], strict=True)]


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first of ``name_2``, ``name_3``, ... that is no column of ``df`` yet."""
    have, n = {c.lower() for c in df.columns}, 1
    while (out := name if n == 1 else f"{name}_{n}").lower() in have:
        n += 1
    return out


def hidden_prefix(df: DataFrame) -> str:
    """A prefix for helper columns with which no column of ``df`` begins."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix
