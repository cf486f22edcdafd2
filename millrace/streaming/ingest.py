"""Streaming ingestion into the chunk table and the BM25 index, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators import postings


def follow(stream: DataFrame, index_path: str, store_path: str, checkpoint: str, tokens: Column, version: str, collection: str = "") -> StreamingQuery:
    """Start following ``chunk_id, text`` rows; a batch that is run again after a failure changes nothing more.

    A batch is written to the store and put into the index as a segment of its own; neither is read as a whole. Of a
    chunk that comes several times in a batch the last text by code point counts.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, path = batch.sparkSession, f"{store_path}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        rows = spark.read.schema(batch.schema).parquet(path).groupBy("chunk_id").agg(F.max("text").alias("text"))
        known = postings.load(spark, index_path, version, collection)
        if known is None:
            postings.create(rows, tokens, index_path, version, collection)
        else:
            postings.put(known, rows, tokens)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
