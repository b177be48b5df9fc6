"""Streams of records into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.database import Database


def upsert_stream(stream: DataFrame, db: Database, collection: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upserts every micro-batch of (id, vector, metadata_json) in one commit.

    A batch that is sent again after a failure writes the same ids with the same
    values, so the live records are the same.
    """

    def write(batch: DataFrame, _: int) -> None:
        if db.collection(collection).upsert_frame(batch):
            db.save()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
