"""Cells on disk: a folder each, with public, hidden and release tables. All cells are read in one scan; the folder's name is the ``cell_slug`` column."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators.board import PAYLOAD
from shelfwise.sources.delimited import decoded, placed, scan

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


TRANSACTIONS = _schema(product_id=_S, store_id=_S, week=_I, units=_D, dollars=_D, price=_D, promo_flag=_I, promo_cost=_D, supply_cost_proxy=_D)
HOLDOUT = _schema(product_id=_S, store_id=_S, week=_I, price=_D, promo_flag=_I, promo_cost=_D, supply_cost_proxy=_D)
SWEEP_CONTEXT = _schema(intervention_id=_S, product_id=_S, store_id=_S, week=_I, baseline_price=_D, intervention_price=_D, promo_cost=_D)
PRODUCTS = _schema(product_id=_S, product_text=_S, brand_code=_S)
STORES = _schema(store_id=_S, market=_S, chain=_S)
ELASTICITY_TRUTH = _schema(priced_product_id=_S, affected_product_id=_S, epsilon_star=_D, epsilon_star_conditional=_D, support=T.BooleanType())
SWEEP_TRUTH = _schema(intervention_id=_S, product_id=_S, store_id=_S, week=_I, baseline_units=_D, true_counterfactual_units=_D)
#: File of each table within a cell.
TABLES = {
    "training": ("public/transactions_train_public.csv", TRANSACTIONS), "holdout": ("public/holdout_context_public.csv", HOLDOUT), "sweep": ("public/counterfactual_sweep_context_public.csv", SWEEP_CONTEXT),
    "products": ("public/products_public.csv", PRODUCTS), "stores": ("public/stores_public.csv", STORES), "panel": ("hidden/transactions_full_hidden.csv", TRANSACTIONS),
    "elasticity_truth": ("hidden/elasticity_truth_hidden.csv", ELASTICITY_TRUTH), "sweep_truth": ("hidden/counterfactual_sweep_truth_hidden.csv", SWEEP_TRUTH),
}
_FAMILY, _WEEKS = "STRUCT<active_cell: STRUCT<model_family: STRING>>", "STRUCT<counterfactual_eval_weeks: INT>"
_RELEASE = f"benchmark_version STRING, benchmark_family {_FAMILY}, simulation {_WEEKS}"
_RUN = f"config STRUCT<benchmark_version: STRING, benchmark_family: {_FAMILY}, simulation: {_WEEKS}>"
MARKERS = ("release/scoring_params.json", "reports/run_config_resolved.json")


def slug_of(path):
    """The folder of the cell that a file (or a part of it) is in."""
    return F.regexp_extract(path, "([^/]+)/(?:public|hidden|release|reports)/", 1)


def discover(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """(cell_slug): folders with a marker file; ``pattern`` is a regular expression for the whole name."""
    found = None
    for marker in MARKERS:
        try:
            own = spark.read.format("binaryFile").load(f"{root}/*/{marker}").select(slug_of(F.col("path")).alias("cell_slug"))
        except AnalysisException as e:  # no cell has this marker
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], "cell_slug string")
    found = found.distinct()
    return found.where(F.col("cell_slug").rlike(f"^(?:{pattern})$")) if pattern else found


def _scanned(spark: SparkSession, root: str, table: str, cells: str = "*"):
    path, schema = TABLES[table]
    return scan(spark, f"{root}/{cells}/{path}", schema.fieldNames(), lambda p: [decoded(slug_of(p)).alias("cell_slug")])


def having(spark: SparkSession, root: str, table: str, cells: str = "*") -> DataFrame:
    """(cell_slug) of the cells that have the table's file, whatever is in it."""
    try:
        files = spark.createDataFrame([(f,) for f in spark.read.text(f"{root}/{cells}/{TABLES[table][0]}").inputFiles()], "path string")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "cell_slug string")
    return files.select(decoded(slug_of(F.col("path"))).alias("cell_slug")).distinct()


def read_table(spark: SparkSession, root: str, table: str, cells: str = "*") -> DataFrame:
    """A table of all cells, by each file's header, ids as text; ``row_ord`` is the place in the source, for picks that go by file order.

    Cells without the file have no rows, files without a column have nulls in it, and what can't be read as its type is null (see ``problems``)."""
    _, schema = TABLES[table]
    found = _scanned(spark, root, table, cells)
    if found is None:  # no cell has this table
        return spark.createDataFrame([], T.StructType([T.StructField("cell_slug", _S), *schema, T.StructField("row_ord", T.LongType())]))
    return found.lines.select("cell_slug", *[found.column(f.name).try_cast(f.dataType).alias(f.name) for f in schema], F.col("at").alias("row_ord"))


#: Columns without which a cell can't be scored, by table.
NEEDED = {
    "panel": ("product_id", "store_id", "week", "units", "dollars", "price"), "elasticity_truth": ("priced_product_id", "affected_product_id", "epsilon_star"),
    "sweep_truth": ("intervention_id", "product_id", "store_id", "week", "baseline_units", "true_counterfactual_units"),
}


def problems(spark: SparkSession, root: str, table: str, cells: str = "*") -> DataFrame:
    """(cell_slug, reason): what is wrong with the table's files, cell by cell: an empty file, a needed column that isn't there, weeks that are no whole numbers.

    Measures that can't be read aren't in it: they count as missing where they are scored."""
    found = _scanned(spark, root, table, cells)
    if found is None:
        return spark.createDataFrame([], "cell_slug string, reason string")
    lacks = F.filter("missing", lambda c: c.isin(*NEEDED[table]))
    header = F.when(F.col("missing").isNull(), F.lit(f"{table}: an empty file")).when(F.size(lacks) > 0, F.concat(F.lit(f"{table}: no column "), F.array_join(lacks, ", ")))
    out = found.files.groupBy("cell_slug").agg(F.min(header).alias("reason")).where("reason is not null")
    if "week" in NEEDED[table]:
        week = found.column("week")
        bad = found.lines.where(week.isNotNull() & week.try_cast("int").isNull()).groupBy("cell_slug").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(bad.select("cell_slug", F.concat(F.lit(f"{table}: "), F.col("n").cast("string"), F.lit(" rows whose week is no whole number")).alias("reason")))
    return out


def read_config(spark: SparkSession, root: str, cells: str = "*") -> DataFrame:
    """(cell_slug, benchmark_version, family, eval_week_count) from the release file, else from the run's."""
    parts = []
    for place, (marker, schema, at) in enumerate(((MARKERS[0], _RELEASE, ""), (MARKERS[1], _RUN, "config."))):
        try:
            raw = spark.read.schema(schema).option("multiLine", True).json(f"{root}/{cells}/{marker}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        parts.append(raw.select(slug_of(F.input_file_name()).alias("cell_slug"), F.coalesce(f"{at}benchmark_version", F.lit("unversioned")).alias("benchmark_version"), F.col(f"{at}benchmark_family.active_cell.model_family").alias("family"), F.col(f"{at}simulation.counterfactual_eval_weeks").alias("eval_week_count"), F.lit(place).alias("place")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return every.groupBy("cell_slug").agg(*[F.min_by(c, "place").alias(c) for c in ("benchmark_version", "family", "eval_week_count")])


def eval_weeks(panel: DataFrame, config: DataFrame) -> DataFrame:
    """The last weeks of each cell, as many as its config says."""
    weeks = panel.where("week is not null").select("cell_slug", "week").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy("cell_slug").orderBy(F.desc("week"))))
    return weeks.join(config.select("cell_slug", "eval_week_count"), "cell_slug").where("place <= eval_week_count").select("cell_slug", "week")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """One JSON line a payload, a folder for each submission and cell."""
    payloads.withColumns({"__s": F.col("submission_name"), "__c": F.col("cell_slug")}).write.partitionBy("__s", "__c").json(path)


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(PAYLOAD).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path)


def write_table(df: DataFrame, root: str, table: str) -> None:
    """A table of all cells into their folders, without ``cell_slug``."""
    path, schema = TABLES[table]
    rows = df.select("cell_slug", *[c for c in schema.fieldNames() if c in df.columns])
    placed(rows, ["cell_slug"], root, path, lambda w, to: w.option("header", True).option("escape", '"').csv(to))


def write_config(config: DataFrame, root: str) -> None:
    """The release file of each cell, from (cell_slug, benchmark_version, family, eval_week_count)."""
    shown = F.struct("benchmark_version", F.struct(F.struct(F.col("family").alias("model_family")).alias("active_cell")).alias("benchmark_family"), F.struct(F.col("eval_week_count").alias("counterfactual_eval_weeks")).alias("simulation"))
    placed(config.dropDuplicates(["cell_slug"]).select("cell_slug", F.to_json(shown).alias("value")), ["cell_slug"], root, MARKERS[0], lambda w, to: w.text(to))


def write_submission(forecast: DataFrame, elasticity: DataFrame, deltas: DataFrame, path: str) -> None:
    """The three CSV tables of submissions, a folder for each cell, and for each variant where there is a column of that name."""
    for name, df in (("forecast_predictions", forecast), ("elasticity_matrix", elasticity), ("counterfactual_deltas", deltas)):
        df.write.partitionBy(*[c for c in ("variant", "cell_slug") if c in df.columns]).option("header", True).csv(f"{path}/{name}")


def write_fit_meta(coefficients: DataFrame, path: str) -> None:
    """What a fit was like, one JSON line for each cell (and variant): products, and how many of them converged."""
    keys = [c for c in ("variant", "cell_slug") if c in coefficients.columns]
    meta = coefficients.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_products"), F.count_if("converged").alias("n_converged"))
    meta.withColumns({f"__{c}": F.col(c) for c in keys}).write.partitionBy(*[f"__{c}" for c in keys]).json(path)


def write_board(board: DataFrame, path: str) -> None:
    """A leaderboard, scorecard or scenario matrix as CSV with a header."""
    board.write.option("header", True).csv(path)
