"""Incremental ingest as a stream: each micro-batch is upserted into a keyed table (K1, S6), or counted in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphweave.sources.ingest import upsert_path
from glyphweave.sources.keyed_table import KeyedTable


def upsert_stream(stream: DataFrame, path: str, key: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Newest row of each key in the table at path, batch by batch. A repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(lambda df, _: upsert_path(df.sparkSession, path, df, key, version)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_keyed(stream: DataFrame, path: str, key: list[str], version: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """The same into a bucketed table: a micro-batch rewrites the buckets that its keys fall into, no others."""
    made = KeyedTable.make(stream.sparkSession, path, stream.schema, key, version, buckets)
    return stream.writeStream.foreachBatch(lambda df, _: made.upsert(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", *by: str) -> DataFrame:
    """Rows that arrive in each window; later ones than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count("*").alias("n"))
