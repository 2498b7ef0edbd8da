"""A landing folder of record batches as a stream.

Each micro-batch goes through the same dedupe as a table at rest; what has been
seen is kept in Parquet, so a rerun from the checkpoint changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.batches import dedupe
from ..sources.json_files import append_new


def ingest(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, key: str = "global_idx", order: str = "ord") -> None:
    """Append new keys of all files that have landed to ``target``, then stop."""

    def batch(df: DataFrame, number: int) -> None:
        append_new(dedupe(df, key, order).drop("slot"), target, key)

    query = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
