"""Loading only the sales files that have not been seen yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillframe.operators.cleaning import clean_sales, rename_sales
from tillframe.sources.files import SALES_SCHEMA


def ingest_new_sales(spark: SparkSession, source: str, target: str, checkpoint: str) -> int:
    """Clean all unseen CSV files of ``source`` into ``target``; returns the batches run.

    Each batch owns the folder of its number, so a batch that is run again after
    a failure replaces its own rows and nothing is loaded twice.
    """
    stream = spark.readStream.schema(SALES_SCHEMA).option("header", True).csv(source)
    done: list[int] = []

    def load(batch: DataFrame, number: int) -> None:
        clean_sales(rename_sales(batch)).write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.append(number)

    query = (
        stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return len(done)
