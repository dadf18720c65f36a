"""Streaming ingest: every micro-batch becomes one log batch, once.

``foreachBatch`` delivers a batch again after a crash; the log refuses a batch
number it has seen from the same stream, so rows are neither lost nor doubled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, name: str, metadata_json: str | None = None, interval: int | None = None, compact_every: int | None = None) -> StreamingQuery:
    """Start logging a stream of (vector, metadata, external_id) rows.

    ``interval`` seconds between batches, or everything there is and stop if it
    is None. Every ``compact_every`` batches the collection is compacted."""

    def put(df: DataFrame, batch: int) -> None:
        collection.refresh()
        collection.insert_df(df, metadata_json, stream=name, batch=batch)
        if compact_every and batch % compact_every == compact_every - 1:
            collection.compact()

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).queryName(name)
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{interval} seconds")).start()


def stop(query: StreamingQuery, collection: Collection) -> Collection:
    """Let what has arrived be logged, stop, and compact."""
    query.processAllAvailable()
    query.stop()
    return collection.refresh().compact()
