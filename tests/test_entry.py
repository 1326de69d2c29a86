"""Queries with Python workers from a driver that wasn't started in the repository."""

import os
import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
spark.range(4).mapInPandas(lambda batches: batches, "id long").collect()  # a worker that has been started already
for name in ("bootstrap_in_band", "first_stage"):
    rows = entry.queries()[name](spark, "/root/testdata/sf0.001")
    print(name, rows.count())
"""


def test_workers_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(HERE), shared=str(tmp_path / "shared"))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    found = dict(line.split() for line in out.stdout.splitlines() if line.startswith(("bootstrap_in_band", "first_stage")))
    assert set(found) == {"bootstrap_in_band", "first_stage"} and all(int(n) > 0 for n in found.values()), out.stderr[-2000:]
