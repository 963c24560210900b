"""Kafka through Spark's connector (its jar must be on the class path)."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import EngineError


def _offset(value: object, topics: list[str]) -> str:
    return value if isinstance(value, str) else json.dumps({t: {str(p): o for p, o in dict(value).items()} for t in topics})


def read_kafka(spark: SparkSession, topics: str | Iterable[str], bootstrap_servers: str, trigger: str = "once", start_offset: object = "earliest", end_offset: object = "latest", consumer_config: dict | None = None, max_batch_size: int | None = None, value_format: str = "raw", schema: str | None = None) -> DataFrame:
    """``once`` reads a bounded range, ``continuous`` a stream; ``json`` makes the value's object the row."""
    if trigger not in ("once", "continuous"):
        raise EngineError(f"unknown trigger {trigger!r}")
    names = [topics] if isinstance(topics, str) else list(topics)
    reader = spark.read if trigger == "once" else spark.readStream
    reader = reader.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", ",".join(names)).option("includeHeaders", "true").option("startingOffsets", _offset(start_offset, names))
    if trigger == "once":
        reader = reader.option("endingOffsets", _offset(end_offset, names))
    elif max_batch_size:
        reader = reader.option("maxOffsetsPerTrigger", max_batch_size)
    for k, v in (consumer_config or {}).items():
        reader = reader.option(f"kafka.{k}", v)
    return decoded(reader.load(), value_format, schema)


def decoded(raw: DataFrame, value_format: str = "raw", schema: str | None = None) -> DataFrame:
    """Kafka's rows in the raw schema, or the JSON object with ``__kafka_`` metadata."""
    rows = raw.select("topic", "partition", "offset", "key", "value", F.unix_millis(F.col("timestamp")).alias("timestamp"), F.col("timestampType").alias("timestamp_type"), *([F.map_from_entries("headers").alias("headers")] if "headers" in raw.columns else []))
    if value_format == "raw":
        return rows
    if value_format != "json" or schema is None:
        raise EngineError("value_format is raw, or json with a schema")
    value = F.from_json(F.col("value").cast("string"), schema, {"mode": "FAILFAST"})
    return rows.withColumn("_v", value).select("_v.*", *(F.col(c).alias(f"__kafka_{c}") for c in rows.columns if c != "value"))


def encoded(df: DataFrame, key_field: str | None = None) -> DataFrame:
    """``key, value`` for Kafka's sink: rows as JSON, the key as text."""
    key = F.col(key_field).cast("string") if key_field else F.lit(None).cast("string")
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_kafka(df: DataFrame, topic: str, bootstrap_servers: str, key_field: str | None = None, producer_config: dict | None = None, checkpoint: str | None = None):
    out = encoded(df, key_field)
    writer = (out.writeStream if df.isStreaming else out.write).format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("topic", topic)
    for k, v in (producer_config or {}).items():
        writer = writer.option(f"kafka.{k}", v)
    return writer.option("checkpointLocation", checkpoint).start() if df.isStreaming else writer.save()
