"""CSV files of many owners: read in one scan, in which each file's own header says where its columns are, so one bad file leaves the others alone; and written in one job."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F


def fields_of(line: Column, n: int) -> Column:
    """A line's first ``n`` fields as an array of text; empty ones are null, and a quote within quotes is doubled."""
    row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(n)), {"escape": '"'})
    return F.array(*[row[f"c{i}"] for i in range(n)])


def decoded(part: Column) -> Column:
    """A name within a file's path, of which the path has special characters as %.. ."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(part, r"\+", "%2B")), part)


def plain(path: Column) -> Column:
    """A file's path as both the reader and the list of its files write it."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*:)/+", "$1/")


class Scan(NamedTuple):
    #: (owner columns, names, missing): a row for each file; ``names`` is null for an empty one, ``missing`` has the wanted columns that its header lacks.
    files: DataFrame
    #: (owner columns, at, fields, names): a row for each line but headers and blank lines; ``at`` follows the order within a file.
    lines: DataFrame

    def column(self, name: str) -> Column:
        """Of ``lines``: the field under that name as text, null where the file has no such column."""
        return F.get("fields", F.array_position("names", name).cast("int") - 1)


def scan(spark: SparkSession, path: str, wanted: Sequence[str], owner: Callable[[Column], list[Column]]) -> Scan | None:
    """Files at a path (a pattern may stand for many), or none if there are none; ``owner`` names a file's columns after its path.

    The headers are read first, for their width comes to the driver; then all rows come from one scan. A line ends where the file's line does."""
    try:
        text = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    there = spark.createDataFrame([(f,) for f in text.inputFiles()], "path string").select(plain(F.col("path")).alias("path"))  # the names have been listed; empty files have no lines
    # a file's first line is the first of the part that begins at its first byte; ``at`` is in scan order, so nothing is filtered below it
    lines = text.select("value", plain(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    first = lines.where("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"), F.min("at").alias("header_at")).withColumn("header", F.regexp_replace("header", "^\\uFEFF", ""))
    width = first.agg(F.max(F.size(F.split("header", ",")))).first()[0] or 1
    names = F.transform(fields_of(F.col("header"), width), lambda c: F.coalesce(c, F.lit("")))
    missing = F.filter(F.array(*[F.lit(c) for c in wanted]), lambda c: ~F.array_contains("names", c))
    headers = first.withColumn("names", names).select("path", "header_at", "names", missing.alias("missing"))
    own = owner(F.col("path"))
    rows = lines.join(headers, "path").where(F.col("at") > F.col("header_at")).select(*own, "at", fields_of(F.col("value"), width).alias("fields"), "names", "missing")
    return Scan(there.join(headers, "path", "left").select(*own, "names", "missing"), rows)


def placed(df: DataFrame, keys: Sequence[str], root: str, path: str, write: Callable[[DataFrameWriter, str], None]) -> None:
    """One write of all owners' rows, parted by ``keys``; then each part is renamed to root/key/.../path, which moves no data. A path that is there already is an error."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    own = place(f"{root}/_writing-{uuid.uuid4().hex}")
    write(df.write.partitionBy(*keys), own.toString())
    files = own.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [(own, root)]
    for key in keys:
        parts = [(child.getPath(), f"{to}/{unquote(name.removeprefix(f'{key}='))}") for at, to in parts for child in files.listStatus(at) if (name := child.getPath().getName()).startswith(f"{key}=")]
    for at, to in parts:
        to = place(f"{to}/{path}")
        files.mkdirs(to.getParent())
        if files.exists(to) or not files.rename(at, to):
            raise OSError(f"{at} can't be moved to {to}")
    files.delete(own, True)
