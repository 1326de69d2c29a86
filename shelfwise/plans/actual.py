"""The actual-data cell: window, split, universe and sweep from a cleaned movement panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.operators.counterfactual import own_price_sweep
from shelfwise.operators.forecast import last_weeks, split_weeks
from shelfwise.sources.movement import clean_movement, read_movement
from shelfwise.staging import fewer_files, staged

WELL_COVERED, UNIVERSE_SHARE = 0.5, 0.80


def last_covered_week(panel: DataFrame) -> DataFrame:
    """One row: the last week with at least WELL_COVERED of the median number of rows, else the last week."""
    weekly = panel.groupBy("week").agg(F.count(F.lit(1)).alias("n"))
    usual = weekly.agg(F.median("n").alias("usual"))
    return weekly.crossJoin(usual).agg(F.coalesce(F.max(F.when(F.col("n") >= WELL_COVERED * F.col("usual"), F.col("week"))), F.max("week")).alias("last_week"))


def window_of(panel: DataFrame, weeks: int, end: int | None = None) -> DataFrame:
    """Rows of the ``weeks`` weeks up to ``end``, by default the last well covered one."""
    last = panel.sparkSession.createDataFrame([(end,)], "last_week int") if end is not None else last_covered_week(panel)
    return panel.join(F.broadcast(last), (F.col("week") <= F.col("last_week")) & (F.col("week") > F.col("last_week") - weeks)).drop("last_week")


def top_universe(training: DataFrame, share: float = UNIVERSE_SHARE, cell: tuple[str, ...] = ("cell_slug",)) -> DataFrame:
    """(cell, product_id): products by training revenue up to and with the one that crosses ``share``; ties by id."""
    revenue = training.groupBy(*cell, "product_id").agg(F.sum("dollars").alias("revenue"))
    before = F.sum("revenue").over(Window.partitionBy(*cell).orderBy(F.desc("revenue"), "product_id").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("revenue").over(Window.partitionBy(*cell))
    return revenue.withColumn("before", F.coalesce(before, F.lit(0.0)) / total).where(F.col("before") < share).select(*cell, "product_id")


def build_cell(movement: DataFrame, slug: str = "actual", window_weeks: int = 156, window_end: int | None = None, holdout_weeks: int = 16) -> dict[str, DataFrame]:
    """panel, training, eval_weeks and sweep of a cleaned movement table; the universe never looks at held-out weeks."""
    movement = staged(fewer_files(movement), "movement")  # the window, the split, the universe and the cell itself all read it
    panel = window_of(movement, window_weeks, window_end).withColumn("cell_slug", F.lit(slug))
    weeks = last_weeks(panel, holdout_weeks)
    training, _ = split_weeks(panel, weeks)
    panel = staged(fewer_files(panel.join(top_universe(training), ["cell_slug", "product_id"], "left_semi")), "panel")
    return {"panel": panel, "training": split_weeks(panel, weeks)[0], "eval_weeks": weeks, "sweep": own_price_sweep(panel, weeks)}


def load_cell(spark: SparkSession, root: str, category: str = "tti", **options) -> dict[str, DataFrame]:
    return build_cell(clean_movement(read_movement(spark, root, category)), **options)


def fixture_cell(panel: DataFrame, products: DataFrame, eval_week_count: int) -> dict[str, DataFrame]:
    """An actual-arm cell from a synthetic panel, for trying the arm without real data."""
    weeks = last_weeks(panel, eval_week_count)
    return {"panel": panel, "training": split_weeks(panel, weeks)[0], "eval_weeks": weeks, "sweep": own_price_sweep(panel, weeks, products)}
