"""Exact quantiles by group in two passes with bounded buffers: a mergeable sketch brackets the place, then only the values within the bracket are counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.staging import staged

#: The sketch is off by at most one in ACCURACY of a group's rows, so a bracket of two of these on each side holds the place; groups of SMALL rows or fewer take all their values.
ACCURACY, SMALL = 10_000, 20_000


def exact_quantile(rows: DataFrame, keys: Sequence[str], value: Column, share: float, name: str) -> DataFrame:
    """(keys, name): the quantile of each group's values that aren't null, linear between the two values around its place; null for groups without values.

    ``rows`` is read twice: a written table. No task holds more of a group than its sketch and the distinct values within
    its bracket, some 6 in ACCURACY of its rows; equal values are counted before they are shuffled."""
    keys = list(keys)
    each = rows.select(*keys, value.cast("double").alias("__v"))
    at = lambda p: F.percentile_approx("__v", F.lit(min(1.0, max(0.0, p))), F.lit(ACCURACY))
    infinite, whole = F.lit(float("inf")), F.col("__n") <= SMALL
    bracket = each.groupBy(*keys).agg(F.count("__v").alias("__n"), at(share - 2 / ACCURACY).alias("__low"), at(share + 2 / ACCURACY).alias("__high"))
    bracket = staged(bracket.select(*keys, "__n", F.when(whole, -infinite).otherwise(F.col("__low")).alias("__low"), F.when(whole, infinite).otherwise(F.col("__high")).alias("__high")), "brackets")
    # values under the bracket are one group, of null, which comes before all others; values above it aren't needed
    placed = each.join(bracket, _same(each, bracket, keys)).where(F.col("__v") <= F.col("__high"))
    counts = placed.groupBy(*[each[k].alias(k) for k in keys], F.col("__n"), F.when(F.col("__v") >= F.col("__low"), F.col("__v")).alias("__at")).agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__at")))
    place = F.lit(share) * (F.col("__n") - 1)
    first = F.floor(place)
    # the value of a place (from 0) is the least one up to which more rows lie than the place says
    value_at = lambda p: F.min(F.when(F.col("__upto") > p, F.col("__at")))
    found = counts.withColumn("__upto", upto).groupBy(*keys).agg(value_at(first).alias("__a"), value_at(F.least(first + 1, F.col("__n") - 1)).alias("__b"), F.first(place - first).alias("__part"))
    out = found.select(*keys, (F.col("__a") + F.col("__part") * (F.col("__b") - F.col("__a"))).alias(name))
    return bracket.join(out, _same(bracket, out, keys), "left").select(*[bracket[k] for k in keys], name)


def with_quantile(rows: DataFrame, keys: Sequence[str], value: Column, share: float, name: str) -> DataFrame:
    """``rows`` with ``name``, the exact quantile of their group as in ``exact_quantile``.

    Groups of SMALL rows or fewer meet whole in one shuffle by key, sorted by value, which later steps by the same keys can keep; only larger groups are sketched and bracketed.
    ``rows`` is read twice, first for its keys and values alone."""
    keys, place = list(keys), F.lit(share) * (F.col("__n") - 1)
    large = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > SMALL).select(*keys), "large")
    some = bool(large.take(1))
    small = rows.join(F.broadcast(large), _same(rows, large, keys), "left_anti") if some else rows
    group = Window.partitionBy(*keys)
    at = lambda k: F.min(F.when(F.col("__at") == k, F.col("__v"))).over(group)
    placed = small.withColumn("__v", value.cast("double"))
    placed = placed.withColumns({"__at": F.row_number().over(group.orderBy(F.asc_nulls_last("__v"))) - 1, "__n": F.count("__v").over(group)})
    placed = placed.withColumns({"__a": at(F.floor(place)), "__b": at(F.least(F.floor(place) + 1, F.col("__n") - 1))})
    out = placed.select(*rows.columns, F.when(F.col("__n") > 0, F.col("__a") + (place - F.floor(place)) * (F.col("__b") - F.col("__a"))).alias(name))
    if not some:
        return out
    rest = staged(rows.join(F.broadcast(large), _same(rows, large, keys), "left_semi"), "large-groups")
    usual = exact_quantile(rest, keys, value, share, name)
    return out.unionByName(rest.join(F.broadcast(usual), _same(rest, usual, keys)).select(*[rest[c] for c in rest.columns], name))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Groups of null keys are groups too."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out
