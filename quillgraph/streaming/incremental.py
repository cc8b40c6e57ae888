"""Incremental embedding of arriving documents (an extension: the batch task has no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.models import embed


def embed_stream(stream: DataFrame, load: Callable, out_path: str, checkpoint: str, model: str = "hash", text: str = "text") -> StreamingQuery:
    """Each micro-batch encodes only texts whose content hash the table lacks, and appends them.

    A batch that is replayed after a failure finds its texts stored already.
    """
    schema = "key string, emb array<float>"

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        spark.createDataFrame([], schema).write.mode("append").parquet(out_path)
        keyed = batch.where(F.col(text).isNotNull()).select(F.sha1(F.concat_ws("\u0000", F.lit(model), text)).alias("key"), F.col(text).alias("t")).dropDuplicates(["key"])
        fresh = keyed.join(spark.read.schema(schema).parquet(out_path).select("key"), "key", "left_anti")
        embed(fresh, "t", load).select("key", "emb").write.mode("append").parquet(out_path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window, with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
