"""An extension: a stream of raw documents that is upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lectern.library import Library

RAW_SCHEMA = "external_id string, title string, text string, kind string, origin string, updated_at string"


def ingest_stream(raw: DataFrame, library: Library, checkpoint: str, created_at: str) -> StreamingQuery:
    """Each micro-batch goes through ``Library.add``; upserts make a repeated batch harmless."""

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            library.add(batch, created_at)

    return raw.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
