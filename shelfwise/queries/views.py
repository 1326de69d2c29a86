"""The given tables as a demand panel with scenarios, truths and submissions: the same arithmetic as DataFrames and as SQL.

Stores are nations, products are brands, weeks are shipping weeks; nations of odd and even number are two seeds of one cell type. Units don't
respond to prices here, so fitted slopes are near 0; scenario truths are arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.operators import forecast
from shelfwise.staging import fewer_files, staged

CELL, EVAL_WEEKS = ["cell_slug"], 16


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def brand_no(c: str = "product_id"):
    return F.substring_index(F.col(c), "#", -1).cast("int")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Written once for each query: training, truth, scenarios and weights all read it."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    net, gross = F.col("p_retailprice") * (1 - F.col("l_discount")) * F.col("l_quantity"), F.col("p_retailprice") * F.col("l_quantity")
    keys = [
        F.concat(F.lit("log_log_seed"), (1 + F.col("s_nationkey") % 2).cast("string")).alias("cell_slug"), F.col("p_brand").alias("product_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("store_id"),
        F.floor(F.datediff("l_shipdate", F.lit("1970-01-01")) / 7).cast("int").alias("week"),
    ]
    panel = rows.groupBy(*keys).agg(
        F.sum("l_quantity").alias("units"), F.sum(net).alias("dollars"), (F.sum(net) / F.sum("l_quantity")).alias("price"), F.max(F.when(F.col("l_discount") > 0.05, 1).otherwise(0)).alias("promo_flag"),
        F.max("l_discount").alias("promo_cost"), (0.7 * F.sum(gross) / F.sum("l_quantity")).alias("supply_cost_proxy"),
    )
    return staged(fewer_files(panel), "panel")


def weeks(p: DataFrame) -> DataFrame:
    return forecast.last_weeks(p, EVAL_WEEKS)


def training(p: DataFrame) -> DataFrame:
    return forecast.split_weeks(p, weeks(p))[0]


def held_out(p: DataFrame) -> DataFrame:
    return forecast.split_weeks(p, weeks(p))[1]


def predictions(p: DataFrame) -> DataFrame:
    """Every fifth key is missing; as many rows are of a store that doesn't exist."""
    h, n = held_out(p), brand_no()
    value = (F.col("units") * (1 + (F.pmod(F.col("week") * 7 + n * 13, F.lit(11)) - 5) / 50.0)).alias("predicted_units")
    store = F.when(F.pmod(F.col("week") + n, F.lit(5)) == 0, F.concat(F.lit("X"), "store_id")).otherwise(F.col("store_id")).alias("store_id")
    return h.select("cell_slug", "product_id", store, "week", value)


SCENARIOS = (("sweep_single_share_highest_plus10", "Brand#1", 1.1), ("sweep_single_random_plus10", "Brand#2", 1.1), ("sweep_single_random_minus10", "Brand#2", 0.9), ("sweep_nothing_moves", "none", 1.0))


def scenario_rows(p: DataFrame) -> DataFrame:
    """Context and truth in one: all held-out rows for each scenario."""
    h, n = held_out(p), brand_no()
    s = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(f).alias("focal"), F.lit(float(x)).alias("by")) for i, f, x in SCENARIOS])).alias("s")
    own = F.col("product_id") == F.col("s.focal")
    dq = F.when(own, F.col("units") * (F.pow("s.by", F.lit(-1.6)) - 1)).otherwise(F.col("units") * 0.02 * (n % 3) * F.signum(F.col("s.by") - 1))
    return h.select("*", s).select(
        "cell_slug", F.col("s.id").alias("intervention_id"), "product_id", "store_id", "week", F.col("price").alias("baseline_price"), F.when(own, F.col("price") * F.col("s.by")).otherwise(F.col("price")).alias("intervention_price"),
        F.col("units").alias("baseline_units"), (F.col("units") + dq).alias("true_counterfactual_units"), (F.col("week") * 100_000 + n * 100 + F.substring("store_id", 2, 9).cast("int")).alias("row_ord"),
    )


def deltas(p: DataFrame) -> DataFrame:
    n = brand_no()
    value = (F.col("true_counterfactual_units") - F.col("baseline_units")) * (1 + (F.pmod(F.col("week") + n, F.lit(7)) - 3) / 10.0)
    return scenario_rows(p).where(F.pmod(F.col("week") + n, F.lit(10)) != 0).select("cell_slug", "intervention_id", "product_id", "store_id", "week", value.alias("predicted_delta_units"))


def matrix_truth(p: DataFrame) -> DataFrame:
    a = p.select("cell_slug", F.col("product_id").alias("affected_product_id"), brand_no().alias("i")).distinct()
    b = p.select("cell_slug", F.col("product_id").alias("priced_product_id"), brand_no().alias("j")).distinct()
    i, j = F.col("i"), F.col("j")
    star = F.when(i == j, -1.2 - i * 0.05).otherwise((F.pmod(i * 7 + j * 3, F.lit(11)) - 5) / 50.0)
    return a.join(b, "cell_slug").select("cell_slug", "affected_product_id", "priced_product_id", star.alias("epsilon_star"), (star + 0.01 * F.pmod(j, F.lit(4))).alias("epsilon_star_conditional"), (F.pmod(i * j, F.lit(13)) != 0).alias("support"), i.alias("i"), j.alias("j"))


def matrix(p: DataFrame) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    out = matrix_truth(p).where(F.pmod(i + j, F.lit(9)) != 0)
    return out.select("cell_slug", "affected_product_id", F.when(F.pmod(i * j, F.lit(17)) == 0, F.concat(F.lit("Y"), "priced_product_id")).otherwise(F.col("priced_product_id")).alias("priced_product_id"), (F.col("epsilon_star") * (1 + (F.pmod(i + j, F.lit(5)) - 2) / 10.0)).alias("elasticity"))


def products(spark: SparkSession, d: str, p: DataFrame) -> DataFrame:
    """Brands with the text of the document of their number."""
    own = p.select("cell_slug", "product_id").distinct().withColumn("n", brand_no())
    named = table(spark, d, "documents").join(F.broadcast(own.select("n").distinct()), F.col("doc_id") == F.col("n"), "left_semi")  # before any text is shuffled
    texts = named.groupBy(F.col("doc_id").alias("brand_number")).agg(F.min("text").alias("product_text"))
    return own.join(texts, F.col("n") == F.col("brand_number"), "left").select("cell_slug", "product_id", "product_text", F.concat(F.lit("B"), (F.col("n") % 8).cast("string")).alias("brand_code"))


def movement(spark: SparkSession, d: str) -> DataFrame:
    week = F.floor(F.datediff("l_shipdate", F.lit("1970-01-01")) / 7).cast("int")
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("upc"), week.alias("week"), F.col("l_quantity").alias("move"), (1 + F.col("l_linenumber") % 2).alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("sale"), (F.col("l_tax") * 100).alias("profit"), F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7), 0).when(F.col("l_linenumber") < 7, 1).alias("ok"),
    )


_SCENARIO_VALUES = ", ".join(f"('{i}', '{f}', {x})" for i, f, x in SCENARIOS)
#: The same views in SQL; every oracle starts with them.
SQL = f"""
WITH panel AS (
  SELECT 'log_log_seed' || (1 + s_nationkey % 2) AS cell_slug, p_brand AS product_id, 'N' || s_nationkey AS store_id, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) / 7) AS INTEGER) AS week,
    sum(l_quantity) AS units, sum(p_retailprice * (1 - l_discount) * l_quantity) AS dollars, sum(p_retailprice * (1 - l_discount) * l_quantity) / sum(l_quantity) AS price,
    max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS promo_flag, max(l_discount) AS promo_cost, 0.7 * sum(p_retailprice * l_quantity) / sum(l_quantity) AS supply_cost_proxy
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4),
weeks AS (SELECT cell_slug, week FROM (SELECT cell_slug, week, dense_rank() OVER (PARTITION BY cell_slug ORDER BY week DESC) AS place FROM (SELECT DISTINCT cell_slug, week FROM panel)) WHERE place <= {EVAL_WEEKS}),
train AS (SELECT * FROM panel ANTI JOIN weeks USING (cell_slug, week)),
held AS (SELECT *, CAST(split_part(product_id, '#', 2) AS INTEGER) AS n FROM panel SEMI JOIN weeks USING (cell_slug, week)),
weights AS (SELECT cell_slug, product_id, sum(dollars) / sum(sum(dollars)) OVER (PARTITION BY cell_slug) AS w FROM train GROUP BY 1, 2),
support AS (SELECT DISTINCT cell_slug, product_id, store_id FROM train WHERE units > 0),
truth AS (SELECT cell_slug, product_id, store_id, week, units AS true_units FROM held SEMI JOIN support USING (cell_slug, product_id, store_id)),
pred AS (SELECT cell_slug, product_id, CASE WHEN (week + n) % 5 = 0 THEN 'X' || store_id ELSE store_id END AS store_id, week, units * (1 + ((week * 7 + n * 13) % 11 - 5) / 50.0) AS predicted_units FROM held),
scenes(id, focal, step) AS (VALUES {_SCENARIO_VALUES}),
scen AS (SELECT cell_slug, id AS intervention_id, product_id, store_id, week, n, price AS baseline_price, CASE WHEN product_id = focal THEN price * CAST(step AS DOUBLE) ELSE price END AS intervention_price, units AS baseline_units,
  CASE WHEN product_id = focal THEN units * (pow(CAST(step AS DOUBLE), -1.6) - 1) ELSE units * 0.02 * (n % 3) * sign(CAST(step AS DOUBLE) - 1) END AS dq_true, week * 100000 + n * 100 + CAST(substr(store_id, 2) AS INTEGER) AS row_ord FROM held, scenes),
scenmap AS (SELECT cell_slug, intervention_id, min_by(product_id, row_ord) FILTER (intervention_price <> baseline_price) AS focal, min_by(CASE WHEN intervention_price > baseline_price THEN 1 ELSE -1 END, row_ord) FILTER (intervention_price <> baseline_price) AS direction FROM scen GROUP BY 1, 2),
frame AS (SELECT scen.*, CASE WHEN (week + n) % 10 = 0 THEN 0.0 ELSE dq_true * (1 + ((week + n) % 7 - 3) / 10.0) END AS dq_pred, (week + n) % 10 = 0 AS unsent FROM scen),
net AS (SELECT *, dq_true - sum(dq_true) OVER s * CASE WHEN sum(baseline_units) OVER s > 0 THEN baseline_units / sum(baseline_units) OVER s ELSE 0 END AS net_true,
  dq_pred - sum(dq_pred) OVER s * CASE WHEN sum(baseline_units) OVER s > 0 THEN baseline_units / sum(baseline_units) OVER s ELSE 0 END AS net_pred FROM frame WINDOW s AS (PARTITION BY cell_slug, intervention_id, store_id, week)),
prods AS (SELECT DISTINCT cell_slug, product_id, CAST(split_part(product_id, '#', 2) AS INTEGER) AS n FROM panel),
star AS (SELECT a.cell_slug, a.product_id AS affected_product_id, b.product_id AS priced_product_id, a.n AS i, b.n AS j, CASE WHEN a.n = b.n THEN -1.2 - a.n * 0.05 ELSE ((a.n * 7 + b.n * 3) % 11 - 5) / 50.0 END AS epsilon_star, (a.n * b.n) % 13 <> 0 AS support FROM prods a JOIN prods b USING (cell_slug)),
entries AS (SELECT star.*, epsilon_star + 0.01 * (j % 4) AS cond, weights.w, CASE WHEN (i + j) % 9 = 0 OR (i * j) % 17 = 0 THEN NULL ELSE epsilon_star * (1 + ((i + j) % 5 - 2) / 10.0) END AS sent FROM star LEFT JOIN weights ON star.cell_slug = weights.cell_slug AND affected_product_id = product_id),
cross_entries AS (SELECT *, coalesce(sent, 0.0) AS hat, coalesce(sent, 0.0) - (epsilon_star - cond) AS hat_basis FROM entries WHERE support AND i <> j),
limits AS (SELECT cell_slug, quantile_cont(abs(cond), 0.2) AS lim FROM cross_entries GROUP BY 1),
labels AS (SELECT c.*, lim, CASE WHEN cond > lim THEN 'substitute' WHEN cond < -lim THEN 'complement' ELSE 'unrelated' END AS true_class, CASE WHEN hat_basis > lim THEN 'substitute' WHEN hat_basis < -lim THEN 'complement' ELSE 'unrelated' END AS hat_class FROM cross_entries c JOIN limits USING (cell_slug))
"""
