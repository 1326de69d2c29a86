"""Movement files, the actual cell, text structure, and recovery of known slopes."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import loglog, panel_fit, shares, text
from shelfwise.plans import actual, grid
from shelfwise.queries import panels
from shelfwise.sources.movement import NoMovementFile, clean_movement, read_movement
from shelfwise.sources.submissions import BadTable, checked
from shelfwise.streaming.movement import movement_stream


def movement_csv(path, bad_header=False):
    rows = ["STORE,UPC,WEEK,MOVE,QTY,PRICE,SALE,PROFIT,OK" if not bad_header else "STORE,UPC"]
    for w in range(1, 43):
        rows += [f"5,111,{w},100,2,4.0,{'B' if w % 4 == 0 else ''},25,1"]
        if w <= 40:
            rows += [f"5,222,{w},50,1,3.0,,20,1", f"5,333,{w},1,1,1.0,,10,"]
    rows += ["5,111,3,7,1,2.0,,25,0", "5,111,3,7,1,0,,25,1", "5,222,5,9,1,838.16,,20,1", "1234,222,6,5,1,3.0,,20,1"]
    path.write_text("\n".join(rows))


def test_actual_cell(spark, tmp_path):
    movement_csv(tmp_path / "wtti.csv")
    cell = actual.load_cell(spark, str(tmp_path), window_weeks=40, holdout_weeks=8)
    panel = {(r.product_id, r.store_id, r.week): r for r in cell["panel"].collect()}
    assert {k[0] for k in panel} == {"U111", "U222"} and {k[1] for k in panel} == {"S005", "S1234"}
    r = panel["U111", "S005", 4]
    assert (r.price, r.units, r.dollars, r.supply_cost_proxy, r.promo_flag) == (2.0, 100.0, 200.0, 1.5, 1) and panel["U111", "S005", 3].promo_flag == 0 and panel["U111", "S005", 3].units == 100
    assert sorted(x.week for x in cell["eval_weeks"].collect())[-1] in (40, 42)
    assert {x.intervention_id.rsplit("_", 1)[1] for x in cell["sweep"].collect()} == {"plus", "minus"}
    assert clean_movement(read_movement(spark, str(tmp_path), "tti")).where("product_id = 'U333'").count() == 40
    with pytest.raises(NoMovementFile):
        read_movement(spark, str(tmp_path), "abc")
    movement_csv(tmp_path / "wbad.csv", True)
    with pytest.raises(NoMovementFile):
        read_movement(spark, str(tmp_path), "bad")


def test_movement_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    movement_csv(tmp_path / "in/a.csv")
    for _ in range(2):
        movement_stream(spark, str(tmp_path / "in"), str(tmp_path / "panel"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "panel")).where("product_id = 'U222'").count() == 41


def test_submission_check(spark):
    df = spark.createDataFrame([("P1", "S1", "7", "x")], "product_id string, store_id string, week string, predicted_units string")
    assert checked(df, "forecast").first().week == 7
    with pytest.raises(BadTable):
        checked(df.drop("week"), "forecast")


def test_text_weights(spark):
    products = spark.createDataFrame([("c", "P1", "soft white paper tissue", "A"), ("c", "P2", "soft white paper towel", "A"), ("c", "P3", "strong kitchen cleaner spray", "B"), ("c", "P4", None, "B")], "cell_slug string, product_id string, product_text string, brand_code string")
    d = {(r.affected_product_id, r.priced_product_id): r.distance for r in text.text_distances(products).collect()}
    assert d["P1", "P2"] < d["P1", "P3"] and d["P1", "P1"] == 0 and np.mean([x for (a, b), x in d.items() if a != b]) == pytest.approx(1)
    for use_text in (True, False):
        w = text.neighbour_weights(products, use_text).groupBy("affected_product_id").agg(F.sum("w").alias("w"), F.count_if(F.col("affected_product_id") == F.col("priced_product_id")).alias("own")).collect()
        assert len(w) == 4 and all(r.w == pytest.approx(1) and r.own == 0 for r in w)


@pytest.fixture(scope="module")
def panel(spark):
    """Poisson units with own elasticity -1.6, four products, three stores, eighty weeks."""
    rng = np.random.default_rng(7)
    rows = []
    for p in range(4):
        for s in range(3):
            cost = rng.uniform(1, 2, 80)
            price = cost * rng.uniform(1.1, 1.4, 80)
            level = 60 * np.exp(rng.normal(0, 0.2)) * (1 + 0.2 * np.sin(2 * np.pi * np.arange(80) / 52))
            units = rng.poisson(level * price**-1.6)
            rows += [("c", f"P{p + 1}", f"S{s + 1}", w, float(units[w]), float(units[w] * price[w]), float(price[w]), float(cost[w])) for w in range(80)]
    return spark.createDataFrame(rows, "cell_slug string, product_id string, store_id string, week int, units double, dollars double, price double, supply_cost_proxy double").cache()


def test_loglog_recovers_the_slope(spark, panel):
    products = spark.createDataFrame([("c", f"P{k}", "AABB"[k - 1]) for k in range(1, 5)], "cell_slug string, product_id string, brand_code string")
    weights = text.kernel_weights(text.brand_distances(products))
    coefficients, levels = loglog.fit(panel, weights, False)
    rows = coefficients.collect()
    assert all(r.beta < 0 for r in rows) and np.mean([r.beta for r in rows]) == pytest.approx(-1.6, abs=0.35)
    sweep = panel.where("week >= 76").select("cell_slug", F.lit("up").alias("intervention_id"), "product_id", "store_id", "week", F.col("price").alias("baseline_price"), F.when(F.col("product_id") == "P1", F.col("price") * 1.1).otherwise(F.col("price")).alias("intervention_price"))
    moved = {r.product_id: r.d for r in loglog.sweep_deltas(sweep, coefficients, levels, weights).groupBy("product_id").agg(F.sum("predicted_delta_units").alias("d")).collect()}
    assert moved["P1"] < 0


def with_gaps(panel, product="P1"):
    return panel.where(f"product_id = '{product}' and pmod(hash(store_id, week), 10) < 6").withColumns({"npi": F.lit(0.0), "log_price": F.log("price")})


def dummies(own):
    stores, weeks = sorted(set(own.store_id)), sorted(set(own.week))
    return np.column_stack([*[own.store_id == s for s in stores], *[own.week == w for w in weeks[1:]]]).astype(float)


def poisson_by_dummies(own, *columns):
    x = np.column_stack([*columns, dummies(own)]).astype(float)
    b = np.linalg.lstsq(x, np.log(own.units + 0.5), rcond=None)[0]
    for _ in range(30):
        mu = np.exp(x @ b)
        b = b + np.linalg.lstsq(x.T @ (x * mu[:, None]), x.T @ (own.units - mu), rcond=None)[0]
    return b


@pytest.mark.parametrize("at_once", [panel_fit.AT_ONCE, 0])
def test_loglog_equals_the_fit_with_dummies(spark, panel, monkeypatch, at_once):
    """On a panel with gaps, against Newton steps on one product's rows with a column for each store and week; plain, and with the first stage's residual;
    with all rounds in one task, and by rounds over all tasks."""
    monkeypatch.setattr(loglog, "maximise", partial(panel_fit.maximise, at_once=at_once))
    rows = with_gaps(panel)
    own = rows.toPandas()
    own = own[own.groupby("week").units.transform("sum") > 0].reset_index(drop=True)
    got = loglog.price_response(rows, False).first()
    assert got.converged and got.beta == pytest.approx(poisson_by_dummies(own, own.log_price)[0], abs=1e-7)
    first = np.column_stack([own.supply_cost_proxy, dummies(own)])
    residual = own.log_price - first @ np.linalg.lstsq(first, own.log_price, rcond=None)[0]
    lines, start = loglog.store_lines(rows)
    for r in loglog.control_function(loglog.staged(lines, "lines"), start).collect():
        here = own.store_id == r.store_id
        assert sorted(r.cf_residual) == pytest.approx(sorted(residual[here]), abs=1e-8)
    got = loglog.price_response(rows, True).first()
    assert got.converged and got.beta == pytest.approx(poisson_by_dummies(own, own.log_price, residual)[0], abs=1e-7)


def test_loglog_of_many_products(spark):
    """Five hundred products in one job, sparse; a few of them against dummies. A row of sums has a few numbers a week, and no group has a row for each task."""
    rng = np.random.default_rng(3)
    rows = []
    for p in range(500):
        for s in range(4):
            weeks = np.flatnonzero(rng.random(40) < 0.5)
            price = rng.uniform(1, 2, len(weeks))
            rows += [("c", f"P{p}", f"S{s}", int(w), float(u), float(np.log(x)), 0.0) for w, x, u in zip(weeks, price, rng.poisson((5 + s) * price**-1.5), strict=True)]
    df = spark.createDataFrame(rows, "cell_slug string, product_id string, store_id string, week int, units double, log_price double, npi double")
    got = {r.product_id: r for r in loglog.price_response(df, False).collect()}
    assert len(got) == 500 and all(r.converged for r in got.values())
    every = df.toPandas()
    for p in ("P0", "P250", "P499"):
        own = every[every.product_id == p]
        own = own[(own.groupby("week").units.transform("sum") > 0) & (own.groupby("store_id").units.transform("sum") > 0)].reset_index(drop=True)
        assert got[p].beta == pytest.approx(poisson_by_dummies(own, own.log_price)[0], abs=1e-7)


def test_a_row_of_sums_is_short():
    rng = np.random.default_rng(1)
    line = type("Line", (), {"at": np.arange(340), "units": rng.poisson(3, 340).astype(float), "log_price": rng.random(340), "npi": rng.random(340), "cf_residual": rng.random(340)})
    total = panel_fit.packed(*loglog.poisson_line(["log_price", "npi", "cf_residual"])(line, np.zeros(343)))
    assert total.nbytes < 20_000


def test_calibration_equals_spark_ml(spark, panel):
    """Level and season around a fixed price response, against Spark ML's generalised linear regression with an offset."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from shelfwise.functions.columns import season

    rows = panel.where("product_id = 'P1'").withColumns({"npi": F.lit(0.0), "log_price": F.log("price")})
    levels = loglog.store_levels(rows)
    response = spark.createDataFrame([("c", "P1", -1.6, 0.0)], "cell_slug string, product_id string, beta double, gamma double")
    got = loglog.calibration(rows, response, levels).first()
    fixed = F.col("offset") - 1.6 * (F.col("log_price") - F.col("p_bar"))
    data = rows.join(levels, ["cell_slug", "product_id", "store_id"]).select("units", fixed.alias("fixed"), *[c.alias(n) for n, c in season("week").items()])
    data = VectorAssembler(inputCols=list(loglog.SEASON), outputCol="x").transform(data)
    model = GeneralizedLinearRegression(family="poisson", link="log", offsetCol="fixed", featuresCol="x", labelCol="units", tol=1e-12, maxIter=50).fit(data)
    assert [got["const"], *[got[c] for c in loglog.SEASON]] == pytest.approx([model.intercept, *model.coefficients], abs=1e-6)


def test_loglog_fit_is_registered_whole(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(panels.v, "panel", lambda *a: None)
    monkeypatch.setattr(panels.v, "training", lambda *a: None)
    monkeypatch.setattr(panels, "_weights", lambda *a: None)
    monkeypatch.setattr(panels.loglog, "fit", lambda *a, **b: seen.append(b) or (None, None))
    panels.loglog_fit(spark, "")
    assert seen == [{}]


def test_variant_grid(spark, panel):
    products = spark.createDataFrame([("c", f"P{k}", "AABB"[k - 1], None) for k in range(1, 5)], "cell_slug string, product_id string, brand_code string, product_text string")
    coefficients, levels, weights = grid.fit_grid(panel.where("week < 60"), products, ("naive_blind", "iv_blind"))
    assert {(r.variant, r.n) for r in coefficients.where("beta < 0").groupBy("variant").agg(F.count("*").alias("n")).collect()} == {("naive_blind", 4), ("iv_blind", 4)}
    assert {r.variant for r in levels.select("variant").distinct().collect()} == {r.variant for r in weights.select("variant").distinct().collect()} == {"naive_blind", "iv_blind"}


def test_choice_model(spark, panel):
    s = shares.store_shares(panel)
    slopes = shares.price_slopes(panel, False)
    assert all(r.target < 0 for r in slopes.collect())
    scale = shares.price_scale(s, slopes)
    prices, r = shares.store_prices(panel, s), shares.rho(shares.incidence(panel), scale)
    assert 0 <= r.first().rho <= 1.5 and scale.first().scale < 0
    e = {(x.affected_product_id, x.priced_product_id): x.elasticity for x in shares.elasticities(s, prices, scale, r).collect()}
    assert all((x < 0) == (a == b) for (a, b), x in e.items())
    levels, seasons = shares.market_levels(panel)
    got = shares.predict_units(panel.where("week >= 70"), s, prices, scale, levels, seasons).agg(F.min("predicted_units"), F.sum("predicted_units")).first()
    assert got[0] >= 0 and got[1] == pytest.approx(panel.where("week >= 70").agg(F.sum("units")).first()[0], rel=0.35)
