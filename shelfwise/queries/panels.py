"""Queries over movement files, text structure, and the estimators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import log_price, season
from shelfwise.operators import counterfactual, forecast, loglog, shares, text
from shelfwise.operators.elasticity import product_grid
from shelfwise.plans import actual
from shelfwise.queries import views as v
from shelfwise.queries.scoring import rounded
from shelfwise.sources.movement import clean_movement
from shelfwise.staging import fewer_files, staged

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = v.SQL + sql
        return f

    return add


_MOVES = """, raw AS (SELECT l_suppkey AS store, l_partkey AS upc, CAST(floor(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) / 7) AS INTEGER) AS week, l_quantity AS move, 1 + l_linenumber % 2 AS qty, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'N' THEN ' ' ELSE l_returnflag END AS sale, l_tax * 100 AS profit, CASE WHEN l_linestatus = 'F' AND l_linenumber = 7 THEN 0 WHEN l_linenumber < 7 THEN 1 END AS ok FROM lineitem),
mv AS (SELECT 'U' || upc AS product_id, 'S' || CASE WHEN length(CAST(store AS VARCHAR)) < 3 THEN lpad(CAST(store AS VARCHAR), 3, '0') ELSE CAST(store AS VARCHAR) END AS store_id, week, move AS units, price / qty * move AS dollars, price / qty AS price, CASE WHEN trim(sale) <> '' THEN 1 ELSE 0 END AS promo_flag, price / qty * (1 - profit / 100) AS cost FROM raw WHERE coalesce(ok, 1) <> 0 AND price > 0 AND qty > 0 AND move > 0),
med AS (SELECT product_id, median(price) AS m FROM mv GROUP BY 1),
clean AS (SELECT product_id, store_id, week, sum(units) AS units, sum(dollars) AS dollars, avg(price) AS price, max(promo_flag) AS promo_flag, avg(cost) AS supply_cost_proxy FROM mv JOIN med USING (product_id) WHERE price <= 10 * m GROUP BY 1, 2, 3)"""
_COVERED = _MOVES + """, wk AS (SELECT week, count(*) AS n FROM clean GROUP BY 1), lastweek AS (SELECT coalesce(max(week) FILTER (n >= 0.5 * (SELECT median(n) FROM wk)), max(week)) AS last_week FROM wk)"""
_WINDOW = _COVERED + """, win AS (SELECT clean.* FROM clean, lastweek WHERE week <= last_week AND week > last_week - 156), ew AS (SELECT week FROM (SELECT DISTINCT week FROM win) ORDER BY week DESC LIMIT 16),
rev AS (SELECT product_id, sum(dollars) AS r FROM win ANTI JOIN ew USING (week) GROUP BY 1),
uni AS (SELECT product_id FROM (SELECT product_id, coalesce(sum(r) OVER (ORDER BY r DESC, product_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(r) OVER () AS b FROM rev) WHERE b < 0.8)"""


@query("movement_clean", _MOVES + " SELECT product_id, store_id, week, units, round(dollars, 8) AS dollars, round(price, 10) AS price, promo_flag, round(supply_cost_proxy, 10) AS supply_cost_proxy FROM clean")
def movement_clean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean_movement(v.movement(spark, d)), 10).withColumn("dollars", F.round("dollars", 8))


@query("covered_week", _COVERED + " SELECT last_week FROM lastweek")
def covered_week(spark: SparkSession, d: str) -> DataFrame:
    return actual.last_covered_week(clean_movement(v.movement(spark, d)))


@query("fixture_cell", """ SELECT p.cell_slug, count(*) AS panel_rows, count(*) FILTER (w.week IS NULL) AS training_rows, 2 * count(*) FILTER (w.week IS NOT NULL AND n % 2 = 0) AS sweep_rows, round(sum(CASE WHEN w.week IS NOT NULL AND n % 2 = 0 THEN 2.0 * units END), 4) AS sweep_units, round(max(CASE WHEN w.week IS NOT NULL AND n % 2 = 0 THEN price * 1.1 END), 6) AS highest_price
FROM panel p JOIN prods USING (cell_slug, product_id) LEFT JOIN weeks w USING (cell_slug, week) GROUP BY 1""")
def fixture_cell(spark: SparkSession, d: str) -> DataFrame:
    """A synthetic panel as an actual-arm cell, swept for every second product."""
    p = v.panel(spark, d)
    cell = actual.fixture_cell(p, p.where(v.brand_no() % 2 == 0), v.EVAL_WEEKS)
    counts = cell["panel"].groupBy("cell_slug").agg(F.count(F.lit(1)).alias("panel_rows")).join(cell["training"].groupBy("cell_slug").agg(F.count(F.lit(1)).alias("training_rows")), "cell_slug")
    swept = cell["sweep"].groupBy("cell_slug").agg(F.count(F.lit(1)).alias("sweep_rows"), F.round(F.sum("baseline_units"), 4).alias("sweep_units"), F.round(F.max("intervention_price"), 6).alias("highest_price"))
    return counts.join(swept, "cell_slug")


@query("universe80", _WINDOW + " SELECT 'actual' AS cell_slug, product_id FROM uni")
def universe80(spark: SparkSession, d: str) -> DataFrame:
    p = actual.window_of(staged(fewer_files(clean_movement(v.movement(spark, d))), "movement"), 156).withColumn("cell_slug", F.lit("actual"))
    return actual.top_universe(forecast.split_weeks(p, forecast.last_weeks(p, 16))[0])


@query("actual_cell", _WINDOW + ", pan AS (SELECT * FROM win SEMI JOIN uni USING (product_id)) SELECT count(*) AS panel_rows, count(*) FILTER (week NOT IN (SELECT week FROM ew)) AS training_rows, 2 * count(*) FILTER (week IN (SELECT week FROM ew)) AS sweep_rows, count(DISTINCT product_id) AS products FROM pan")
def actual_cell(spark: SparkSession, d: str) -> DataFrame:
    cell = actual.build_cell(clean_movement(v.movement(spark, d)))
    counts = [cell["panel"].agg(F.count(F.lit(1)).alias("panel_rows"), F.count_distinct("product_id").alias("products")), cell["training"].agg(F.count(F.lit(1)).alias("training_rows")), cell["sweep"].agg(F.count(F.lit(1)).alias("sweep_rows"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


_STOP = ("the", "and", "of", "to", "in", "is", "de", "la", "der")
_TFIDF = f""", pd AS (SELECT prods.cell_slug, prods.product_id, (SELECT min(text) FROM documents WHERE doc_id = n) AS product_text, 'B' || (n % 8) AS brand_code FROM prods),
tok AS (SELECT cell_slug, product_id, list_filter(regexp_extract_all(lower(coalesce(product_text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({", ".join(f"'{w}'" for w in _STOP)})) AS ws FROM pd),
terms AS (SELECT cell_slug, product_id, unnest(list_concat(ws, CASE WHEN len(ws) > 1 THEN list_transform(range(1, len(ws)), lambda k: ws[k] || ' ' || ws[k + 1]) ELSE CAST([] AS VARCHAR[]) END)) AS term FROM tok),
tf AS (SELECT cell_slug, product_id, term, count(*) AS tf FROM terms GROUP BY 1, 2, 3), dfs AS (SELECT cell_slug, term, count(*) AS df FROM tf GROUP BY 1, 2), nn AS (SELECT cell_slug, count(*) AS n FROM prods GROUP BY 1),
rw AS (SELECT tf.cell_slug, product_id, tf.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfs USING (cell_slug, term) JOIN nn USING (cell_slug)),
tfidf AS (SELECT cell_slug, product_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY cell_slug, product_id)) AS weight FROM rw),
dots AS (SELECT a.cell_slug, a.product_id AS p, b.product_id AS q, sum(a.weight * b.weight) AS dot FROM tfidf a JOIN tfidf b ON a.cell_slug = b.cell_slug AND a.term = b.term AND a.product_id <> b.product_id GROUP BY 1, 2, 3),
rd AS (SELECT a.cell_slug, a.product_id AS affected_product_id, b.product_id AS priced_product_id, CASE WHEN a.product_id = b.product_id THEN 0 ELSE 1 - coalesce(dot, 0) END AS raw FROM prods a JOIN prods b USING (cell_slug) LEFT JOIN dots ON dots.cell_slug = a.cell_slug AND p = a.product_id AND q = b.product_id),
dist AS (SELECT cell_slug, affected_product_id, priced_product_id, raw / avg(CASE WHEN affected_product_id <> priced_product_id THEN raw END) OVER (PARTITION BY cell_slug) AS distance FROM rd)"""


@query("tfidf", _TFIDF + " SELECT cell_slug, product_id, term, round(weight, 6) AS weight FROM tfidf")
def tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.tfidf(v.products(spark, d, v.panel(spark, d)), leave_out=_STOP))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return text.text_distances(v.products(spark, d, v.panel(spark, d)), leave_out=_STOP)


@query("text_distance", _TFIDF + " SELECT cell_slug, affected_product_id, priced_product_id, round(distance, 6) AS distance FROM dist")
def text_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d))


@query("rank_norm", _TFIDF + """, u AS (SELECT cell_slug, affected_product_id AS a, priced_product_id AS b, row_number() OVER (PARTITION BY cell_slug ORDER BY round(distance, 8), affected_product_id, priced_product_id) / count(*) OVER (PARTITION BY cell_slug) AS r FROM dist WHERE affected_product_id < priced_product_id)
SELECT cell_slug, a AS affected_product_id, b AS priced_product_id, round(r, 6) AS distance FROM u UNION ALL SELECT cell_slug, b, a, round(r, 6) FROM u UNION ALL SELECT cell_slug, product_id, product_id, 0.0 FROM prods""")
def rank_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.rank_normalised(_distances(spark, d), digits=8))


_BRAND = """, bd AS (SELECT a.cell_slug, a.product_id AS i, b.product_id AS k, CASE WHEN a.n % 8 = b.n % 8 THEN 0.0 ELSE 1.0 END AS distance FROM prods a JOIN prods b USING (cell_slug) WHERE a.product_id <> b.product_id),
kn AS (SELECT cell_slug, i AS affected_product_id, k AS priced_product_id, exp(-distance / 0.5) AS e FROM bd QUALIFY row_number() OVER (PARTITION BY cell_slug, i ORDER BY distance, k) <= 5),
kw AS (SELECT cell_slug, affected_product_id, priced_product_id, e / sum(e) OVER (PARTITION BY cell_slug, affected_product_id) AS w FROM kn)"""


@query("brand_kernel_weights", _BRAND + " SELECT cell_slug, affected_product_id, priced_product_id, round(w, 6) AS w FROM kw")
def brand_kernel_weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_weights(v.panel(spark, d)))


def _weights(p: DataFrame) -> DataFrame:
    own = p.select("cell_slug", "product_id").distinct().withColumn("brand_code", (v.brand_no() % 8).cast("string"))
    return text.kernel_weights(text.brand_distances(own))


@query("text_kernel_weights", _TFIDF + """, u AS (SELECT cell_slug, affected_product_id AS a, priced_product_id AS b, row_number() OVER (PARTITION BY cell_slug ORDER BY round(distance, 8), affected_product_id, priced_product_id) / count(*) OVER (PARTITION BY cell_slug) AS r FROM dist WHERE affected_product_id < priced_product_id),
rn AS (SELECT cell_slug, a AS i, b AS k, r FROM u UNION ALL SELECT cell_slug, b, a, r FROM u),
kn AS (SELECT cell_slug, i AS affected_product_id, k AS priced_product_id, exp(-r / 0.5) AS e FROM rn QUALIFY row_number() OVER (PARTITION BY cell_slug, i ORDER BY r, k) <= 5)
SELECT cell_slug, affected_product_id, priced_product_id, round(e / sum(e) OVER (PARTITION BY cell_slug, affected_product_id), 6) AS w FROM kn""")
def text_kernel_weights(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours on the text axis: the five nearest by ranks of text distances."""
    return rounded(text.kernel_weights(text.rank_normalised(_distances(spark, d), digits=8)))


@query("gaussian_kernel", ", u AS (SELECT a.cell_slug, a.product_id AS i, b.product_id AS k, ((a.n + b.n) % 10) / 10.0 AS dd FROM prods a JOIN prods b USING (cell_slug)) SELECT cell_slug, i AS affected_product_id, k AS priced_product_id, round(exp(-dd * dd / (2 * 0.35 * 0.35)), 6) AS kernel FROM u")
def gaussian_kernel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(text.gaussian_kernel(_ranks(v.panel(spark, d))))


def _ranks(p: DataFrame) -> DataFrame:
    return product_grid(p).withColumn("distance", F.pmod(v.brand_no("affected_product_id") + v.brand_no("priced_product_id"), F.lit(10)) / 10.0)


@query("season_harmonics", " SELECT DISTINCT week, round(sin(2 * pi() * (week % 52) / 52), 6) + 0.0 AS season_sin1, round(cos(2 * pi() * (week % 52) / 52), 6) + 0.0 AS season_cos1, round(sin(4 * pi() * (week % 52) / 52), 6) + 0.0 AS season_sin2, round(cos(4 * pi() * (week % 52) / 52), 6) + 0.0 AS season_cos2 FROM panel")
def season_harmonics(spark: SparkSession, d: str) -> DataFrame:
    w = v.panel(spark, d).select("week").distinct()
    return w.select("week", *[(F.round(c, 6) + 0.0).alias(n) for n, c in season("week").items()])


_INDEX = _BRAND + """, lp AS (SELECT cell_slug, store_id, week, product_id, avg(ln(greatest(price, 0.01))) AS lp FROM train GROUP BY 1, 2, 3, 4), us AS (SELECT cell_slug, product_id, avg(lp) AS us FROM lp GROUP BY 1, 2),
npi AS (SELECT t.cell_slug, t.product_id, t.store_id, t.week, sum(w * coalesce(lp.lp, us.us, 0)) AS npi FROM train t JOIN kw ON t.cell_slug = kw.cell_slug AND t.product_id = affected_product_id LEFT JOIN lp ON lp.cell_slug = t.cell_slug AND lp.store_id = t.store_id AND lp.week = t.week AND lp.product_id = priced_product_id LEFT JOIN us ON us.cell_slug = t.cell_slug AND us.product_id = priced_product_id GROUP BY 1, 2, 3, 4)"""


@query("neighbour_index", _INDEX + " SELECT cell_slug, product_id, store_id, week, round(npi, 6) AS npi FROM npi")
def neighbour_index(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(loglog.neighbour_index(v.training(p), _weights(p)).select("cell_slug", "product_id", "store_id", "week", "npi"))


_LEVELS = _INDEX + ", lev AS (SELECT t.cell_slug, t.product_id, t.store_id, ln(greatest(avg(units), 0.05)) AS off, avg(ln(greatest(price, 0.01))) AS p_bar, avg(npi) AS npi_bar FROM train t JOIN npi USING (cell_slug, product_id, store_id, week) GROUP BY 1, 2, 3)"


@query("store_levels", _LEVELS + ' SELECT cell_slug, product_id, store_id, round(off, 6) AS "offset", round(p_bar, 6) AS p_bar, round(npi_bar, 6) AS npi_bar FROM lev')
def store_levels(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(loglog.store_levels(loglog.prepared(v.training(p), _weights(p))))


def _coefficients(p: DataFrame) -> DataFrame:
    n = v.brand_no()
    return p.select("cell_slug", "product_id").distinct().withColumns({"beta": -1.0 - n / 50.0, "gamma": n / 100.0, "const": F.lit(0.1), "season_sin1": F.lit(0.05), "season_cos1": F.lit(-0.02), "season_sin2": F.lit(0.01), "season_cos2": F.lit(0.0)})


_MEAN = _LEVELS + """, hl AS (SELECT cell_slug, store_id, week, product_id, avg(ln(greatest(price, 0.01))) AS lp FROM held GROUP BY 1, 2, 3, 4), hu AS (SELECT cell_slug, product_id, avg(lp) AS us FROM hl GROUP BY 1, 2), mo AS (SELECT cell_slug, median(off) AS mo FROM lev GROUP BY 1),
hn AS (SELECT t.cell_slug, t.product_id, t.store_id, t.week, sum(w * coalesce(hl.lp, hu.us, 0)) AS npi FROM held t JOIN kw ON t.cell_slug = kw.cell_slug AND t.product_id = affected_product_id LEFT JOIN hl ON hl.cell_slug = t.cell_slug AND hl.store_id = t.store_id AND hl.week = t.week AND hl.product_id = priced_product_id LEFT JOIN hu ON hu.cell_slug = t.cell_slug AND hu.product_id = priced_product_id GROUP BY 1, 2, 3, 4),
x AS (SELECT h.*, ln(greatest(price, 0.01)) AS lp, npi, coalesce(off, mo) AS off, p_bar, npi_bar, 2 * pi() * (week % 52) / 52 AS ph FROM held h JOIN hn USING (cell_slug, product_id, store_id, week) LEFT JOIN lev USING (cell_slug, product_id, store_id) JOIN mo USING (cell_slug))"""


@query("predicted_mean", _MEAN + " SELECT cell_slug, product_id, store_id, week, round(exp(0.1 + off + (-1.0 - n / 50.0) * (lp - coalesce(p_bar, lp)) + n / 100.0 * (npi - coalesce(npi_bar, npi)) + 0.05 * sin(ph) - 0.02 * cos(ph) + 0.01 * sin(2 * ph)), 5) AS predicted_units FROM x")
def predicted_mean(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    levels = loglog.store_levels(loglog.prepared(v.training(p), _weights(p)))
    out = loglog.predict_mean(v.held_out(p), _coefficients(p), levels, _weights(p))
    return out.select("cell_slug", "product_id", "store_id", "week", F.round("predicted_units", 5).alias("predicted_units"))


@query("loglog_elasticities", _BRAND + " SELECT s.cell_slug, s.affected_product_id, s.priced_product_id, round(CASE WHEN i = j THEN -1.0 - i / 50.0 ELSE i / 100.0 * coalesce(w, 0.0) END, 6) AS elasticity FROM star s LEFT JOIN kw USING (cell_slug, affected_product_id, priced_product_id)")
def loglog_elasticities(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(loglog.elasticities(_coefficients(p), _weights(p), p))


_SWEEP = _LEVELS + """, mo AS (SELECT cell_slug, median(off) AS mo FROM lev GROUP BY 1), lg AS (SELECT cell_slug, intervention_id, leg, product_id, store_id, week, n, CASE leg WHEN 0 THEN baseline_price ELSE intervention_price END AS price FROM scen, (VALUES (0), (1)) AS l(leg)),
sl AS (SELECT cell_slug, intervention_id, leg, store_id, week, product_id, avg(ln(greatest(price, 0.01))) AS lp FROM lg GROUP BY ALL), su AS (SELECT cell_slug, intervention_id, leg, product_id, avg(lp) AS us FROM sl GROUP BY ALL),
sn AS (SELECT t.cell_slug, t.intervention_id, t.leg, t.product_id, t.store_id, t.week, sum(w * coalesce(sl.lp, su.us, 0)) AS npi FROM lg t JOIN kw ON t.cell_slug = kw.cell_slug AND t.product_id = affected_product_id
  LEFT JOIN sl ON sl.cell_slug = t.cell_slug AND sl.intervention_id = t.intervention_id AND sl.leg = t.leg AND sl.store_id = t.store_id AND sl.week = t.week AND sl.product_id = priced_product_id
  LEFT JOIN su ON su.cell_slug = t.cell_slug AND su.intervention_id = t.intervention_id AND su.leg = t.leg AND su.product_id = priced_product_id GROUP BY ALL),
x AS (SELECT lg.*, ln(greatest(price, 0.01)) AS lp, npi, coalesce(off, mo) AS off, p_bar, npi_bar, 2 * pi() * (week % 52) / 52 AS ph FROM lg JOIN sn USING (cell_slug, intervention_id, leg, product_id, store_id, week) LEFT JOIN lev USING (cell_slug, product_id, store_id) JOIN mo USING (cell_slug)),
mean AS (SELECT *, exp(0.1 + off + (-1.0 - n / 50.0) * (lp - coalesce(p_bar, lp)) + n / 100.0 * (npi - coalesce(npi_bar, npi)) + 0.05 * sin(ph) - 0.02 * cos(ph) + 0.01 * sin(2 * ph)) AS u FROM x)"""


@query("loglog_sweep_deltas", _SWEEP + " SELECT cell_slug, intervention_id, product_id, store_id, week, round(sum(CASE leg WHEN 1 THEN u ELSE -u END), 5) + 0.0 AS predicted_delta_units FROM mean GROUP BY ALL")
def loglog_sweep_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Scenario responses of given coefficients."""
    p = v.panel(spark, d)
    levels = loglog.store_levels(loglog.prepared(v.training(p), _weights(p)))
    out = loglog.sweep_deltas(v.scenario_rows(p), _coefficients(p), levels, _weights(p))
    return out.withColumn("predicted_delta_units", F.round("predicted_delta_units", 5) + 0.0)


def _demean_sql(source: str, columns: tuple[str, ...], groups: tuple[str, ...], weight: str | None, keep: str, passes: int = 4) -> tuple[str, str]:
    """The passes unrolled: one select for each group of each pass."""
    out, last = "", source
    for p in range(passes):
        for g, by in enumerate(groups):
            mean = lambda c: f"sum({weight} * {c}) OVER (PARTITION BY {by}) / sum({weight}) OVER (PARTITION BY {by})" if weight else f"avg({c}) OVER (PARTITION BY {by})"  # noqa: B023, E731
            name = f"{source}_{p}_{g}"
            out += f", {name} AS MATERIALIZED (SELECT {keep}, " + ", ".join(f"{c} - {mean(c)} AS {c}" for c in columns) + f" FROM {last})"
            last = name
    return out, last


_FS = ", fs AS (SELECT cell_slug, product_id, store_id, week, ln(greatest(price, 0.01)) AS p, supply_cost_proxy AS c FROM train)"
_FS_DM, _FS_LAST = _demean_sql("fs", ("p", "c"), ("cell_slug, product_id, store_id", "cell_slug, product_id, week"), None, "cell_slug, product_id, store_id, week", 60)
_FIRST_STAGE = _FS + _FS_DM + f""", sl AS (SELECT cell_slug, product_id, sum(p * c) / sum(c * c) AS b FROM {_FS_LAST} GROUP BY 1, 2)
SELECT cell_slug, product_id, count(*) AS n_rows, round(b, 6) AS slope, round(sqrt(avg(pow(p - b * c, 2))), 6) AS residual_rms FROM {_FS_LAST} JOIN sl USING (cell_slug, product_id) GROUP BY cell_slug, product_id, b"""


@query("first_stage", _FIRST_STAGE)
def first_stage(spark: SparkSession, d: str) -> DataFrame:
    """What store and week effects and the cost instrument leave of each product's log prices."""
    rows = v.training(v.panel(spark, d)).withColumns({"log_price": log_price("price"), "npi": F.lit(0.0)})
    lines, start = loglog.store_lines(rows)
    lines = staged(fewer_files(lines), "lines")
    left = loglog.control_function(lines, start).select("cell_slug", "product_id", "slope", F.explode("cf_residual").alias("r"))
    out = left.groupBy("cell_slug", "product_id", "slope").agg(F.count(F.lit(1)).alias("n_rows"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("residual_rms"))
    return rounded(out)


@query("loglog_fit")
def loglog_fit(spark: SparkSession, d: str) -> DataFrame:
    """Instrumented fit with brand neighbours, all products in one job."""
    p = v.panel(spark, d)
    return loglog.fit(v.training(p), _weights(p), True)[0]


_SHARES = ", tot AS (SELECT *, sum(units) OVER (PARTITION BY cell_slug, store_id, week) AS tot FROM train), sp AS (SELECT cell_slug, product_id, store_id, week, ln(greatest(units / tot, 1e-6)) AS y, price AS x, supply_cost_proxy AS z, units AS wt FROM tot WHERE tot > 0 AND units > 0)"


@query("share_panel", _SHARES + " SELECT cell_slug, product_id, store_id, week, round(y, 9) AS log_share, round(x, 9) AS price, round(z, 9) AS supply_cost_proxy, wt FROM sp")
def share_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.share_panel(v.training(v.panel(spark, d)), False), 9)


_DM, _DM_LAST = _demean_sql("sp", ("y", "x", "z"), ("cell_slug, product_id, store_id", "cell_slug, week"), "wt", "cell_slug, product_id, store_id, week, wt")
_SLOPES = _SHARES + _DM + f""", pooled AS (SELECT cell_slug, sum(wt * z * y) / sum(wt * z * x) AS pooled FROM {_DM_LAST} GROUP BY 1), own AS (SELECT cell_slug, product_id, sum(wt * z * y) / sum(wt * z * x) AS own FROM {_DM_LAST} GROUP BY 1, 2 HAVING count(*) >= 200 AND sum(wt * z * y) / sum(wt * z * x) < 0)
SELECT t.cell_slug, t.product_id, round(coalesce(own, pooled, 0.0), 6) + 0.0 AS target FROM (SELECT DISTINCT cell_slug, product_id FROM train) t JOIN pooled USING (cell_slug) LEFT JOIN own ON own.cell_slug = t.cell_slug AND own.product_id = t.product_id"""


@query("share_slopes_iv", _SLOPES)
def share_slopes_iv(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(shares.price_slopes(v.training(v.panel(spark, d)), True))
    return out.withColumn("target", F.col("target") + 0.0)


_INC = """, uw AS (SELECT cell_slug, product_id, sum(units) / greatest(sum(sum(units)) OVER (PARTITION BY cell_slug), 1) AS w FROM train GROUP BY 1, 2), sw AS (SELECT t.cell_slug, store_id, week, ln(sum(units)) AS y, sum(w * price) / greatest(sum(w), 1e-9) AS x FROM train t JOIN uw USING (cell_slug, product_id) GROUP BY 1, 2, 3 HAVING sum(units) > 0)"""
_INC_DM, _INC_LAST = _demean_sql("sw", ("y", "x"), ("cell_slug, store_id", "cell_slug, week"), None, "cell_slug, store_id, week")


@query("incidence_slope", _INC + _INC_DM + f" SELECT cell_slug, round(sum(x * y) / sum(x * x), 8) AS slope FROM {_INC_LAST} GROUP BY 1")
def incidence_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.incidence(v.training(v.panel(spark, d))), 8)


_STORE = ", su AS MATERIALIZED (SELECT cell_slug, store_id, product_id, sum(units) AS u FROM train GROUP BY 1, 2, 3), st AS (SELECT cell_slug, store_id, sum(u) AS t FROM su GROUP BY 1, 2 HAVING sum(u) > 0), ss AS (SELECT st.cell_slug, st.store_id, tp.product_id, coalesce(u, 0) / t AS share FROM st JOIN (SELECT DISTINCT cell_slug, product_id FROM train) tp USING (cell_slug) LEFT JOIN su ON su.cell_slug = st.cell_slug AND su.store_id = st.store_id AND su.product_id = tp.product_id)"


@query("store_shares", _STORE + " SELECT cell_slug, store_id, product_id, round(share, 6) AS share FROM ss")
def store_shares(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.store_shares(v.training(v.panel(spark, d))))


@query("store_prices", _STORE + """, o AS (SELECT cell_slug, store_id, product_id, avg(price) AS own FROM train GROUP BY 1, 2, 3), a AS (SELECT cell_slug, product_id, avg(own) AS across FROM o GROUP BY 1, 2), g AS (SELECT cell_slug, avg(p) AS overall FROM (SELECT cell_slug, product_id, avg(price) AS p FROM train GROUP BY 1, 2) GROUP BY 1)
SELECT ss.cell_slug, ss.store_id, ss.product_id, round(coalesce(own, across, overall), 6) AS mean_price FROM ss LEFT JOIN o USING (cell_slug, store_id, product_id) LEFT JOIN a USING (cell_slug, product_id) JOIN g USING (cell_slug)""")
def store_prices(spark: SparkSession, d: str) -> DataFrame:
    t = v.training(v.panel(spark, d))
    return rounded(shares.store_prices(t, shares.store_shares(t)))


def _targets(p: DataFrame) -> DataFrame:
    return p.select("cell_slug", "product_id").distinct().withColumn("target", -0.001 - v.brand_no() / 100_000.0)


_SCALE = _STORE + """, pw AS (SELECT cell_slug, product_id, avg(share) AS w, avg(1 - share) AS room FROM ss GROUP BY 1, 2), sc AS (SELECT cell_slug, sum(w * (-0.001 - n / 100000.0)) AS num, sum(w * room) AS den, sum(greatest(w, 1e-9) * (-0.001 - n / 100000.0)) / sum(greatest(w, 1e-9)) AS mean FROM pw JOIN prods USING (cell_slug, product_id) GROUP BY 1), scl AS (SELECT cell_slug, CASE WHEN den > 1e-9 THEN least(greatest(num / den, 4 * least(mean, 0)), 0) END AS scale FROM sc)"""


@query("price_scale", _SCALE + " SELECT cell_slug, round(scale, 9) AS scale FROM scl")
def price_scale(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    return rounded(shares.price_scale(shares.store_shares(v.training(p)), _targets(p)), 9)


@query("market_levels", ", wk AS (SELECT cell_slug, store_id, week, sum(units) AS m FROM train GROUP BY 1, 2, 3) SELECT cell_slug, store_id, round(avg(m), 6) AS level FROM wk GROUP BY 1, 2")
def market_levels(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shares.market_levels(v.training(v.panel(spark, d)))[0])


def _choice(p: DataFrame):
    t = v.training(p)
    s = staged(fewer_files(shares.store_shares(t)), "store-shares")
    scale = shares.price_scale(s, _targets(p))
    return s, shares.store_prices(t, s), scale, shares.rho(shares.incidence(t), scale), *shares.market_levels(t)


_CHOICE = _SCALE + _INC + _INC_DM + f""", o AS (SELECT cell_slug, store_id, product_id, avg(price) AS own FROM train GROUP BY 1, 2, 3), a AS (SELECT cell_slug, product_id, avg(own) AS across FROM o GROUP BY 1, 2), g AS (SELECT cell_slug, avg(p) AS overall FROM (SELECT cell_slug, product_id, avg(price) AS p FROM train GROUP BY 1, 2) GROUP BY 1),
pr AS (SELECT ss.cell_slug, ss.store_id, ss.product_id, share, scale, coalesce(own, across, overall) AS mean_price FROM ss LEFT JOIN o USING (cell_slug, store_id, product_id) LEFT JOIN a USING (cell_slug, product_id) JOIN g USING (cell_slug) JOIN scl USING (cell_slug)),
inc AS (SELECT cell_slug, sum(x * y) / sum(x * x) AS slope FROM {_INC_LAST} GROUP BY 1), rh AS (SELECT cell_slug, CASE WHEN scale >= -1e-9 THEN 0.0 ELSE least(greatest(slope / scale, 0.0), 1.5) END AS rho FROM inc JOIN scl USING (cell_slug)),
vol AS (SELECT cell_slug, store_id, week, sum(units) AS m FROM train GROUP BY 1, 2, 3), lvl AS (SELECT cell_slug, store_id, avg(m) AS level FROM vol GROUP BY 1, 2), usual AS (SELECT cell_slug, median(level) AS usual FROM lvl GROUP BY 1),
rel AS (SELECT cell_slug, m / level AS r, sin(2 * pi() * (week % 52) / 52) AS s, cos(2 * pi() * (week % 52) / 52) AS c FROM vol JOIN lvl USING (cell_slug, store_id)),
mom AS (SELECT cell_slug, count(*) AS n, sum(s) AS s, sum(c) AS c, sum(s * s) AS ss, sum(s * c) AS sc, sum(c * c) AS cc, sum(r) AS r, sum(s * r) AS sr, sum(c * r) AS cr FROM rel GROUP BY 1),
det AS (SELECT *, n * (ss * cc - sc * sc) - s * (s * cc - sc * c) + c * (s * sc - ss * c) AS d FROM mom),
sea AS (SELECT cell_slug, (r * (ss * cc - sc * sc) - s * (sr * cc - sc * cr) + c * (sr * sc - ss * cr)) / d AS c0, (n * (sr * cc - sc * cr) - r * (s * cc - sc * c) + c * (s * cr - sr * c)) / d AS c1, (n * (ss * cr - sr * sc) - s * (s * cr - sr * c) + r * (s * sc - ss * c)) / d AS c2 FROM det)"""
_MARKET = "coalesce(level, usual) * greatest(c0 + c1 * sin(2 * pi() * (week % 52) / 52) + c2 * cos(2 * pi() * (week % 52) / 52), 0.05)"


@query("choice_forecast", _CHOICE + f""", seen AS (SELECT cell_slug, store_id, week, product_id, avg(price) AS price FROM held GROUP BY ALL), grid AS (SELECT w.week, pr.*, greatest(share, 1e-4) * exp(scale * (coalesce(price, mean_price) - mean_price)) AS raw FROM (SELECT DISTINCT cell_slug, store_id, week FROM held) w JOIN pr USING (cell_slug, store_id) LEFT JOIN seen ON seen.cell_slug = pr.cell_slug AND seen.store_id = pr.store_id AND seen.week = w.week AND seen.product_id = pr.product_id),
un AS (SELECT cell_slug, store_id, week, product_id, raw / sum(raw) OVER (PARTITION BY cell_slug, store_id, week) * {_MARKET} AS u FROM grid LEFT JOIN lvl USING (cell_slug, store_id) JOIN usual USING (cell_slug) JOIN sea USING (cell_slug))
SELECT h.cell_slug, h.product_id, h.store_id, h.week, round(coalesce(u, 0.0), 6) AS predicted_units FROM held h LEFT JOIN un USING (cell_slug, store_id, week, product_id)""")
def choice_forecast(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    s, prices, scale, _, levels, seasons = _choice(p)
    return rounded(shares.predict_units(v.held_out(p), s, prices, scale, levels, seasons))


_CHOICE_SWEEP = _CHOICE + f""", mv AS (SELECT cell_slug, intervention_id, count(DISTINCT product_id) AS n_focals, min(product_id) AS focal FROM scen WHERE abs(intervention_price - baseline_price) > 1e-12 GROUP BY 1, 2),
seen AS (SELECT cell_slug, intervention_id, store_id, week, product_id, avg(baseline_price) AS bp, avg(intervention_price) AS ip FROM scen GROUP BY ALL),
g0 AS (SELECT w.intervention_id, w.week, pr.*, coalesce(bp, mean_price) AS p0, coalesce(ip, mean_price) AS p1, n_focals, focal, coalesce(pr.product_id = focal, false) AS own, ((CAST(split_part(focal, '#', 2) AS INTEGER) + CAST(split_part(pr.product_id, '#', 2) AS INTEGER)) % 10) / 10.0 AS dd
  FROM (SELECT DISTINCT cell_slug, intervention_id, store_id, week FROM scen) w JOIN pr USING (cell_slug, store_id) LEFT JOIN seen ON seen.cell_slug = pr.cell_slug AND seen.intervention_id = w.intervention_id AND seen.store_id = pr.store_id AND seen.week = w.week AND seen.product_id = pr.product_id LEFT JOIN mv ON mv.cell_slug = pr.cell_slug AND mv.intervention_id = w.intervention_id),
g1 AS (SELECT *, greatest(share, 1e-4) * exp(scale * (p0 - mean_price)) / sum(greatest(share, 1e-4) * exp(scale * (p0 - mean_price))) OVER pl AS s0, greatest(share, 1e-4) * exp(scale * (p1 - mean_price)) / sum(greatest(share, 1e-4) * exp(scale * (p1 - mean_price))) OVER pl AS s1 FROM g0 WINDOW pl AS (PARTITION BY cell_slug, intervention_id, store_id, week)),
g2 AS (SELECT *, CASE WHEN own THEN 0.0 ELSE s0 * coalesce(0.5 * exp(-dd * dd / (2 * 0.35 * 0.35)) + 0.5, 1.0) END AS w FROM g1),
g3 AS (SELECT *, sum(CASE WHEN own THEN s0 - s1 END) OVER pl AS lost, sum(w) OVER pl AS total, ln(greatest(sum(s0 * exp(scale * (p1 - p0))) OVER pl, 1e-9)) AS dcv FROM g2 WINDOW pl AS (PARTITION BY cell_slug, intervention_id, store_id, week)),
g4 AS (SELECT *, CASE WHEN n_focals = 1 THEN CASE WHEN own THEN s1 ELSE s0 + CASE WHEN total > 0 THEN lost * w / total ELSE 0.0 END END ELSE s1 END AS cf FROM g3),
dl AS (SELECT cell_slug, intervention_id, store_id, week, product_id, cf * {_MARKET} * exp(least(greatest(rho * dcv, -10.0), 10.0)) - s0 * {_MARKET} AS d FROM g4 JOIN rh USING (cell_slug) LEFT JOIN lvl USING (cell_slug, store_id) JOIN usual USING (cell_slug) JOIN sea USING (cell_slug))"""


@query("choice_sweep_deltas", _CHOICE_SWEEP + " SELECT s.cell_slug, s.intervention_id, s.product_id, s.store_id, s.week, round(coalesce(d, 0.0), 6) + 0.0 AS predicted_delta_units FROM scen s LEFT JOIN dl USING (cell_slug, intervention_id, store_id, week, product_id)")
def choice_sweep_deltas(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    s, prices, scale, r, levels, seasons = _choice(p)
    out = shares.sweep_deltas(v.scenario_rows(p), s, prices, scale, r, levels, seasons, text.gaussian_kernel(_ranks(p)))
    return out.withColumn("predicted_delta_units", F.round("predicted_delta_units", 6) + 0.0)


@query("choice_elasticities", _CHOICE + """, pool AS (SELECT cell_slug, product_id, avg(share) AS share, avg(mean_price) AS mean_price FROM pr GROUP BY 1, 2), p0 AS (SELECT *, greatest(share, 1e-4) / sum(greatest(share, 1e-4)) OVER (PARTITION BY cell_slug) AS s0, CAST(split_part(product_id, '#', 2) AS INTEGER) AS n FROM pool),
e0 AS (SELECT i.cell_slug, i.product_id AS affected_product_id, k.product_id AS priced_product_id, i.product_id = k.product_id AS own, i.s0, k.s0 AS sk, exp(scale * 0.1 * k.mean_price) AS bump, ((i.n + k.n) % 10) / 10.0 AS dd, rho FROM p0 i JOIN p0 k USING (cell_slug) JOIN scl USING (cell_slug) JOIN rh USING (cell_slug)),
e1 AS (SELECT *, ln(greatest(1 + sk * (bump - 1), 1e-9)) AS dcv, sk * bump / (1 + sk * (bump - 1)) AS s1, CASE WHEN own THEN 0.0 ELSE s0 * coalesce(0.5 * exp(-dd * dd / (2 * 0.35 * 0.35)) + 0.5, 1.0) END AS w FROM e0),
e2 AS (SELECT *, sum(CASE WHEN own THEN s0 - s1 END) OVER pl AS lost, sum(w) OVER pl AS total FROM e1 WINDOW pl AS (PARTITION BY cell_slug, priced_product_id)),
e3 AS (SELECT *, CASE WHEN own THEN s1 ELSE s0 + CASE WHEN total > 0 THEN lost * w / total ELSE 0.0 END END AS cf FROM e2)
SELECT cell_slug, affected_product_id, priced_product_id, round(CASE WHEN s0 > 0 THEN (cf * exp(least(greatest(rho * dcv, -10.0), 10.0)) - s0) / s0 / 0.1 ELSE 0.0 END, 6) + 0.0 AS elasticity FROM e3""")
def choice_elasticities(spark: SparkSession, d: str) -> DataFrame:
    p = v.panel(spark, d)
    s, prices, scale, r, _, _ = _choice(p)
    out = shares.elasticities(s, prices, scale, r, text.gaussian_kernel(_ranks(p)))
    return out.withColumn("elasticity", F.round("elasticity", 6) + 0.0)


@query("naive_tables", "SELECT cell_slug, intervention_id, product_id, store_id, week, CAST(0 AS DOUBLE) AS predicted_delta_units FROM (SELECT DISTINCT cell_slug, intervention_id, product_id, store_id, week FROM scen)")
def naive_tables(spark: SparkSession, d: str) -> DataFrame:
    return forecast.naive_deltas(v.scenario_rows(v.panel(spark, d)))


@query("naive_elasticities", "SELECT cell_slug, affected_product_id, priced_product_id, CAST(0 AS DOUBLE) AS elasticity FROM star")
def naive_elasticities(spark: SparkSession, d: str) -> DataFrame:
    return forecast.naive_elasticities(v.panel(spark, d).select("cell_slug", "product_id").distinct())


@query("flagship", "SELECT cell_slug, focal FROM scenmap WHERE intervention_id = 'sweep_single_share_highest_plus10'")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    return counterfactual.flagship(counterfactual.scenario_map(v.scenario_rows(v.panel(spark, d)))).select("cell_slug", "focal")
