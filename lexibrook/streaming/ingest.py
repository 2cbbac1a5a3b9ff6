"""Streaming ingest of log records into storage (an extension): each micro-batch replays what storage lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lexibrook.plans.storage import replay
from lexibrook.sources.records import files_at

SCHEMA = "doc_id bigint, text string, offset bigint"


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents at a path, or an empty frame where nothing was stored yet."""
    if files_at(path):
        return spark.read.schema("doc_id bigint, text string").parquet(path)
    return spark.createDataFrame([], "doc_id bigint, text string")


def ingest(log: DataFrame, storage: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over log(doc_id, text, offset) that appends first versions to the Parquet storage; repeats are skipped.

    A batch that runs again after a failure finds its documents stored and adds nothing."""

    def apply(batch: DataFrame, _: int) -> None:
        replay(batch, stored_documents(batch.sparkSession, storage)).select("doc_id", "text").write.mode("append").parquet(storage)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
