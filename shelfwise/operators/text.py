"""Substitution structure from product texts: TF-IDF, cosine and brand distances, rank normalisation, neighbour kernels. Long tables throughout.

The word list that is left out is a parameter; by default it is Spark ML's English one. Other than the reference's vectoriser it is not tied to one library's list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.operators.elasticity import AFFECTED, PRICED, product_grid
from shelfwise.staging import staged

CELL = ("cell_slug",)
NEIGHBOURS, BANDWIDTH, RANK_BANDWIDTH = 5, 0.5, 0.35


def stop_words() -> list[str]:
    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def tfidf(products: DataFrame, cell: Sequence[str] = CELL, leave_out: Sequence[str] | None = None) -> DataFrame:
    """(cell, product_id, term, weight): words of two or more characters and pairs of them; 1 + ln tf, smoothed idf, unit length."""
    out = F.array(*map(F.lit, stop_words() if leave_out is None else leave_out))
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("product_text", F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~F.array_contains(out, w))
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(0), F.size("words") - 2), lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    n = products.groupBy(*cell).agg(F.count_distinct("product_id").alias("n"))
    tf = products.withColumn("words", words).select(*cell, "product_id", F.explode(F.concat("words", pairs)).alias("term")).groupBy(*cell, "product_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy(*cell, "term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, [*cell, "term"]).join(n, list(cell)).withColumn("raw", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*cell, "product_id")))
    return raw.select(*cell, "product_id", "term", (F.col("raw") / length).alias("weight"))


def text_distances(products: DataFrame, cell: Sequence[str] = CELL, leave_out: Sequence[str] | None = None) -> DataFrame:
    """(cell, affected, priced, distance): cosine distances with mean 1 off the diagonal. Pairs that share no term are found by the grid, not by a join."""
    t = staged(tfidf(products, cell, leave_out), "tfidf")
    a = t.select(*cell, "term", F.col("product_id").alias(AFFECTED), F.col("weight").alias("x"))
    b = t.select(*cell, "term", F.col("product_id").alias(PRICED), F.col("weight").alias("y"))
    # each pair once; a term of one product alone meets nothing
    dots = a.join(b, [*cell, "term"]).where(F.col(AFFECTED) < F.col(PRICED)).groupBy(*cell, AFFECTED, PRICED).agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    dots = staged(dots, "dots")
    both = dots.unionByName(dots.select(*cell, F.col(PRICED).alias(AFFECTED), F.col(AFFECTED).alias(PRICED), "dot"))
    n = products.groupBy(*cell).agg(F.count_distinct("product_id").alias("n"))
    mean = n.join(both.groupBy(*cell).agg(F.sum("dot").alias("dot")), list(cell), "left").select(*cell, (1 - F.coalesce("dot", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).alias("mean"))
    grid = product_grid(products, cell).join(both, [*cell, AFFECTED, PRICED], "left").join(mean, list(cell))
    raw = F.when(F.col(AFFECTED) == F.col(PRICED), 0.0).otherwise(1 - F.coalesce("dot", F.lit(0.0)))
    return grid.select(*cell, AFFECTED, PRICED, (raw / F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)).alias("distance"))


def brand_distances(products: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """0 within a brand, 1 across."""
    brand = products.select(*cell, "product_id", F.coalesce(F.col("brand_code").cast("string"), F.lit("")).alias("brand")).distinct()
    a, b = (brand.withColumnsRenamed({"product_id": p, "brand": n}) for p, n in ((AFFECTED, "a"), (PRICED, "b")))
    return a.join(b, list(cell)).select(*cell, AFFECTED, PRICED, F.when((F.col("a") == F.col("b")) | (F.col(AFFECTED) == F.col(PRICED)), 0.0).otherwise(1.0).alias("distance"))


def global_rank(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (from 1) and ``n`` within each of ``keys``, by columns whose values differ between rows, sorted by all tasks.

    Ranges of (keys, order) are dealt to tasks; a row's place is its place within its range, and the rows in the ranges before it."""
    ranged = staged(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    each = ranged.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    total = each.groupBy(*keys).agg(F.collect_list(F.struct("__range", "__n")).alias("__all"))
    add = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x["__n"])
    before = add(F.filter("__all", lambda x: x["__range"] < F.col("__range")))
    starts = each.join(total, list(keys)).select(*keys, "__range", before.alias("__before"), add(F.col("__all")).alias("n"))
    within = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))
    return ranged.withColumn("__within", within).join(starts, [*keys, "__range"]).select(*rows.columns, (F.col("__before") + F.col("__within")).alias("place"), "n")


def rank_normalised(distances: DataFrame, cell: Sequence[str] = CELL, digits: int = 12) -> DataFrame:
    """Distances as their rank among the cell's pairs, in (0, 1]; ties, up to ``digits``, by product ids."""
    distances = staged(distances, "distances")
    upper = distances.where(F.col(AFFECTED) < F.col(PRICED)).select(*cell, AFFECTED, PRICED, F.round("distance", digits).alias("near"))
    ranked = global_rank(upper, cell, ["near", AFFECTED, PRICED]).select(*cell, AFFECTED, PRICED, (F.col("place") / F.col("n")).alias("distance"))
    ranked = staged(ranked, "ranked")
    mirrored = ranked.select(*cell, F.col(PRICED).alias(AFFECTED), F.col(AFFECTED).alias(PRICED), "distance")
    diagonal = distances.where(F.col(AFFECTED) == F.col(PRICED)).select(*cell, AFFECTED, PRICED, F.lit(0.0).alias("distance"))
    return ranked.unionByName(mirrored).unionByName(diagonal)


def kernel_weights(distances: DataFrame, cell: Sequence[str] = CELL, bandwidth: float = BANDWIDTH, k: int = NEIGHBOURS) -> DataFrame:
    """(cell, affected, priced, w): exp(-distance / bandwidth) of the k nearest others, summing to 1; ties by product id."""
    over = Window.partitionBy(*cell, AFFECTED)
    near = distances.where(F.col(AFFECTED) != F.col(PRICED)).withColumn("nth", F.row_number().over(over.orderBy("distance", PRICED))).where(F.col("nth") <= k)
    raw = near.withColumn("raw", F.exp(-F.col("distance") / bandwidth))
    return raw.select(*cell, AFFECTED, PRICED, (F.col("raw") / F.sum("raw").over(over)).alias("w"))


def gaussian_kernel(ranked: DataFrame, cell: Sequence[str] = CELL, bandwidth: float = RANK_BANDWIDTH) -> DataFrame:
    """(cell, affected, priced, kernel): closeness of rank-normalised distances; 1 on the diagonal."""
    d = F.col("distance")
    return ranked.select(*cell, AFFECTED, PRICED, F.exp(-(d * d) / (2 * bandwidth * bandwidth)).alias("kernel"))


def neighbour_weights(products: DataFrame, use_text: bool, cell: Sequence[str] = CELL) -> DataFrame:
    return kernel_weights(rank_normalised(text_distances(products, cell), cell) if use_text else brand_distances(products, cell), cell)
