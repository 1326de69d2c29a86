"""Column expressions of the demand operators. Text that isn't a number, NaN and null count as missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SEASON_WEEKS = 52
LEAST_PRICE = 0.01


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def measure(c: Column | str) -> Column:
    """A number, or null where there is none."""
    x = _col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def filled(c: Column | str) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(measure(c), F.lit(0.0))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether two numbers agree within tolerance of the second; a missing one agrees with nothing."""
    return F.coalesce(F.abs(a - b) <= absolute + relative * F.abs(b), F.lit(False))


def log_price(price: Column | str) -> Column:
    """ln of the price, at least LEAST_PRICE; null stays null."""
    p = _col(price)
    return F.when(p.isNotNull(), F.log(F.greatest(p, F.lit(LEAST_PRICE))))


def phase(week: Column | str) -> Column:
    return F.lit(2 * math.pi) * F.pmod(_col(week).cast("double"), F.lit(float(SEASON_WEEKS))) / SEASON_WEEKS


def season(week: Column | str) -> dict[str, Column]:
    """Two harmonics of the year."""
    p = phase(week)
    return {"season_sin1": F.sin(p), "season_cos1": F.cos(p), "season_sin2": F.sin(2 * p), "season_cos2": F.cos(2 * p)}


def bounded_exp(x: Column, bound: float = 30.0) -> Column:
    return F.exp(F.least(F.greatest(x, F.lit(-bound)), F.lit(bound)))


def ratio(num: Column, den: Column, above: float = 0.0) -> Column:
    """num / den where den is greater than ``above``, else null."""
    return F.when(den > above, num / den)


def product_code(upc: Column) -> Column:
    return F.concat(F.lit("U"), upc.cast("long").cast("string"))


def store_code(store: Column) -> Column:
    """``S`` and at least three digits; longer numbers are not cut."""
    s = store.cast("long").cast("string")
    return F.concat(F.lit("S"), F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0")))


def promo_flag(deal: Column) -> Column:
    return (F.trim(F.coalesce(deal.cast("string"), F.lit(""))) != "").cast("int")


def cost_from_margin(unit_price: Column, margin_percent: Column) -> Column:
    return unit_price * (1.0 - margin_percent.cast("double") / 100.0)


def cell_type(slug: Column | str) -> Column:
    return F.regexp_replace(_col(slug), r"_seed\d+$", "")


def family(slug: Column | str) -> Column:
    s = _col(slug)
    return F.when(s.contains("covariance_probit"), "covariance_probit").when(s.contains("log_log"), "log_log")


def has_text(text: Column | str) -> Column:
    """Aggregate: whether any text is not blank."""
    return F.max(F.length(F.trim(F.coalesce(_col(text), F.lit("")))) > 0)
