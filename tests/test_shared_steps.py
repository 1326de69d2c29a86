"""Steps that queries share are done once, and early where they make tables smaller."""

from pyspark.sql import functions as F

from shelfwise.queries import files
from shelfwise.queries import views as v


def test_both_arms_share_one_panel(monkeypatch):
    """One panel is built, and both arms get it."""
    got = []
    monkeypatch.setattr(files.v, "panel", lambda spark, d: got.append("built") or "panel")
    for name in ("payloads", "actual_payloads"):
        monkeypatch.setattr(files, name, lambda spark, d, p=None: got.append(p))
    monkeypatch.setattr(files.board, "conformed", lambda x: x)
    monkeypatch.setattr(files, "staged", lambda x, name: x, raising=False)
    try:
        files.QUERIES["board_of_both_arms"](None, "")
    except AttributeError:
        pass  # no tables to go on with
    assert got == ["built", "panel", "panel"]


def test_texts_of_the_brands_alone_are_shuffled(spark, tmp_path):
    spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (7, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    p = spark.createDataFrame([("c", "Brand#1"), ("c", "Brand#2"), ("c", "Brand#3")], "cell_slug string, product_id string").withColumn("units", F.lit(1.0))
    out = v.products(spark, str(tmp_path), p)
    assert "LeftSemi" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.product_id, r.product_text) for r in out.collect()} == {("Brand#1", "a"), ("Brand#2", None), ("Brand#3", None)}
