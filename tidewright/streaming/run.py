"""Running continuous queries to their end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that keyed processing needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """A folder for a query's offsets and state, below the shared checkpoint folder if the session names one."""
    import os
    import tempfile

    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "tidewright-checkpoints")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _batches_with_input_only(stream: DataFrame) -> Iterator[None]:
    """State that expires makes Spark ask for one more batch without end; a query that drains its input stops without them."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")
    if "ProcessingTime" in stream._jdf.queryExecution().logical().toString():
        conf.set(name, "false")
    try:
        yield
    finally:
        conf.set(name, before)


def drain(stream: DataFrame, output_mode: str = "append") -> DataFrame:
    """All that a stream yields for the input available now, written to the shared folder and read as a table."""
    spark = stream.sparkSession
    at = checkpoint_location(spark, "drain")
    if output_mode == "append":
        with _batches_with_input_only(stream):
            query = stream.writeStream.format("parquet").option("path", f"{at}/data").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/data")

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/data/batch={batch_id}")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{at}/state").outputMode(output_mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{at}/data").parquet(f"{at}/data")
