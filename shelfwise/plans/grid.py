"""The four log-log variants (instrument or not, text neighbours or brand neighbours) over all cells, told apart by a ``variant`` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import has_text
from shelfwise.operators import loglog, text
from shelfwise.staging import staged

VARIANTS = {"naive_blind": (False, False), "naive_text": (False, True), "iv_blind": (True, False), "iv_text": (True, True)}
CELL = ("variant", "cell_slug")


def fit_grid(training: DataFrame, products: DataFrame, variants=tuple(VARIANTS), iterations: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(coefficients, levels, weights), each with ``variant``; cells without product texts skip the text variants.

    The variant is a key like the cell, so all variants with an instrument are one fit, and all without one another."""
    texts = products.groupBy("cell_slug").agg(has_text("product_text").alias("has")).where("has")
    fits, every = [], []
    for use_iv in (False, True):
        weights, rows = [], []
        for name in variants:
            if VARIANTS[name][0] == use_iv:
                use_text = VARIANTS[name][1]
                kept = (lambda df: df.join(texts, "cell_slug", "left_semi")) if use_text else (lambda df: df)
                weights.append(text.neighbour_weights(kept(products), use_text).withColumn("variant", F.lit(name)))
                rows.append(kept(training).withColumn("variant", F.lit(name)))
        if weights:
            own = staged(reduce(DataFrame.unionByName, weights), "weights")
            fits.append(loglog.fit(reduce(DataFrame.unionByName, rows), own, use_iv, CELL, iterations))
            every.append(own)
    return (*(reduce(DataFrame.unionByName, x) for x in zip(*fits, strict=True)), reduce(DataFrame.unionByName, every))
