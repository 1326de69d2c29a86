"""Exact quantiles against numpy: groups within and beyond the sketch's size, ties, nulls, null keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import quantiles


@pytest.mark.parametrize("share", [0.5, 0.2, 0.0, 1.0, 0.9999])
def test_exact_quantile(spark, monkeypatch, share):
    monkeypatch.setattr(quantiles, "SMALL", 200)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = np.random.default_rng(3)
    groups = {
        ("a", 1): rng.normal(0, 1, 30_000), ("a", None): rng.integers(0, 4, 9_000).astype(float), (None, 2): rng.lognormal(0, 2, 5_001), ("b", 1): np.array([3.0]),
        ("b", 2): np.array([1.0, 2.0]), ("c", 1): np.full(2_000, 7.0), ("c", 2): np.sort(rng.random(1_000)), ("d", 1): np.array([]),
    }
    rows = [(*key, float(v)) for key, values in groups.items() for v in values] + [(*key, None) for key in groups]
    df = spark.createDataFrame(rows, "g string, k int, x double").repartition(5)
    got = {(r.g, r.k): r.q for r in quantiles.exact_quantile(df, ["g", "k"], F.col("x"), share, "q").collect()}
    assert got == {key: pytest.approx(float(np.quantile(values, share)), rel=1e-12) if len(values) else None for key, values in groups.items()}


def test_a_large_group_is_bracketed(spark):
    """At the real sizes: of a million rows, the counted values are those near the place."""
    df = spark.range(1_000_000).select(F.lit("p").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(1_000_003)) / 3.0).alias("x"))
    values = np.sort((np.arange(1_000_000, dtype=np.int64) * 7919 % 1_000_003) / 3.0)
    got = quantiles.exact_quantile(df, ["g"], F.col("x"), 0.5, "m").first()
    assert got.m == pytest.approx(float(np.median(values)), rel=1e-12)


@pytest.mark.parametrize("share", [0.5, 0.2, 0.0, 1.0, 0.9999])
def test_rows_with_their_quantile(spark, monkeypatch, share):
    """Small groups by their sorted rows, larger ones by brackets; every row stays, of null keys and null values too."""
    monkeypatch.setattr(quantiles, "SMALL", 200)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = np.random.default_rng(5)
    groups = {("a", 1): rng.normal(0, 1, 3_000), ("a", None): rng.integers(0, 4, 900).astype(float), (None, 2): rng.lognormal(0, 2, 101), ("b", 1): np.array([3.0]), ("b", 2): np.array([1.0, 2.0]), ("c", 1): np.full(60, 7.0), ("d", 1): np.array([])}
    rows = [(*key, float(v)) for key, values in groups.items() for v in values] + [(*key, None) for key in groups]
    got = quantiles.with_quantile(spark.createDataFrame(rows, "g string, k int, x double").repartition(5), ["g", "k"], F.col("x"), share, "q").collect()
    assert len(got) == len(rows)
    want = {key: pytest.approx(float(np.quantile(values, share)), rel=1e-12) if len(values) else None for key, values in groups.items()}
    assert all(r.q == want[r.g, r.k] for r in got)


def test_movement_is_shuffled_once(spark):
    """By product: the usual price, the outliers and the sums of a key all keep that."""
    from shelfwise.sources.movement import clean_movement

    raw = spark.createDataFrame([(1, 2, 3, 4.0, 1, 5.0), (1, 2, 3, 1.0, 1, 6.0), (1, 2, 4, 1.0, 1, 70.0), (2, 2, 4, 1.0, 1, 5.0)], "store int, upc int, week int, move double, qty int, price double")
    out = clean_movement(raw)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted((r.store_id, r.week, r.units) for r in out.collect()) == [("S001", 3, 5.0), ("S002", 4, 1.0)]
