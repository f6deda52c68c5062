"""Scores records as their files arrive: a stream of records against a static index of references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lakeweave.operators import retrieval


def retrieve_new(spark: SparkSession, folder: str, references: DataFrame, tokens: Column, out: str, checkpoint: str, k: int = 5, max_df: int | None = 5000, min_keep: int = 5) -> StreamingQuery:
    """Takes all files of parquet records (country, entity_id, ...) that are new since the last call, and ends.

    Each micro-batch writes its own folder, named by its number, so a batch that is run again replaces itself.
    """
    schema = spark.read.parquet(folder).schema
    index = retrieval.bags(references, tokens)

    def batch(records: DataFrame, number: int) -> None:
        retrieval.retrieve(retrieval.bags(records, tokens), index, k, max_df, min_keep).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
