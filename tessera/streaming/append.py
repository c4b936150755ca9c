"""Streaming append: each micro-batch becomes blocks of a store; late rows are kept where they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import store


def commit(batch: DataFrame, number: int, path: str) -> None:
    """One micro-batch as block ``number``. A batch whose index was written is not written again; one that ended before it is, and the rows of
    the first attempt are in no index."""
    spark = batch.sparkSession
    marked = batch.withColumn("block", F.lit(number).cast("bigint"))
    if store.exists(spark, f"{path}/index") and not spark.read.schema(store.INDEX).parquet(f"{path}/index").where(F.col("block") == number).isEmpty():
        return
    if not marked.isEmpty():
        store.append(marked, path)


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows (pos, t, symbol and others) as block = number of the micro-batch."""
    return rows.writeStream.foreachBatch(lambda batch, number: commit(batch, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
