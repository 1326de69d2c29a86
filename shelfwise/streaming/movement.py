"""Movement files as a stream: each batch of new files is cleaned like a file and added to the panel, keyed by its own batch.

Files hold whole weeks, so the batch rules (outliers by the median, one row a key) hold within a batch; there is no state to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.sources.movement import clean_movement

COLUMNS = "store string, upc string, week string, move string, qty string, price string, sale string, profit string, ok string"


def movement_stream(spark: SparkSession, folder: str, panel: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Cleans new files of ``folder`` into the Parquet table ``panel``; a batch that is run again replaces what it wrote."""

    def add(batch: DataFrame, number: int) -> None:
        clean_movement(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(panel)

    rows = spark.readStream.schema(COLUMNS).option("header", True).csv(folder)
    stream = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
