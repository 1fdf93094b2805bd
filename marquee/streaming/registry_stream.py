"""Keyed registry maintained from a stream of updates.

The asset registry (key -> URL or 'error') receives results as they arrive.
Each micro-batch is applied with the same last-wins upsert as the batch
operator (S8) and written as a new version of the table, so a restarted
query resumes from its checkpoint and re-applying a batch is idempotent
(the write is an overwrite of a version folder named by the batch id).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.operators.linkage import upsert_latest


def apply_batch(spark: SparkSession, table_root: str, key: str, seq: str):
    """foreachBatch function: merge the batch into the latest version."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            existing = batch.limit(0)
        else:  # a version that cannot be read is an error, not an empty registry
            existing = spark.read.parquet(f"{table_root}/v{batch_id - 1}")
        merged = upsert_latest(existing, batch, key, seq)
        merged.write.mode("overwrite").parquet(f"{table_root}/v{batch_id}")

    return run


def start_registry_stream(spark: SparkSession, source_dir: str, schema, table_root: str,
                          checkpoint: str, key: str = "imdb_id", seq: str = "seq",
                          once: bool = True):
    """Stream parquet update files from ``source_dir`` into versioned registry
    tables under ``table_root``."""
    updates = spark.readStream.schema(schema).parquet(source_dir)
    w = (updates.writeStream.foreachBatch(apply_batch(spark, table_root, key, seq))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if once else w.trigger(processingTime="30 seconds")
    return w.start()
