"""Incremental ingestion: new match documents into a store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tallyforge.sources.matches import MATCH, normalize
from tallyforge.sources.store import Store


def ingest(spark: SparkSession, documents: str, store: Store, checkpoint: str, **names) -> StreamingQuery:
    """Upserts the documents that appear below a path, once each; a batch that runs again changes nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for table, rows in normalize(batch, **names).items():
            store.upsert(table, rows)
        batch.unpersist()

    return spark.readStream.schema(MATCH).json(documents).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
