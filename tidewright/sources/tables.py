"""Catalog tables and the factories behind their connectors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewright.errors import SQLQueryError
from tidewright.operators.changelog import ALL_KINDS, INSERT_ONLY
from tidewright.sources import kafka, sinks


@dataclass(frozen=True)
class TableColumn:
    name: str
    data_type: str
    nullable: bool = True


@dataclass(frozen=True)
class CatalogTable:
    name: str
    columns: tuple[TableColumn, ...]
    options: dict[str, str] = field(default_factory=dict)
    temporary: bool = False

    def ddl(self) -> str | None:
        return ", ".join(f"`{c.name}` {c.data_type}" + ("" if c.nullable else " NOT NULL") for c in self.columns) or None


class TableFactory:
    """What a connector provides; sinks take inserts only unless they say otherwise."""

    connector = ""

    def validate(self, table: CatalogTable) -> None:
        return None

    def create_source(self, spark: SparkSession, table: CatalogTable) -> DataFrame:
        raise SQLQueryError(f"the connector {self.connector} has no source")

    def write(self, spark: SparkSession, table: CatalogTable, rows: DataFrame) -> Any:
        raise SQLQueryError(f"the connector {self.connector} has no sink")

    def supported_sink_row_kinds(self, table: CatalogTable) -> frozenset[str]:
        return INSERT_ONLY


def _prefixed(options: dict[str, str], prefix: str) -> dict[str, str]:
    return {k[len(prefix) :]: v for k, v in options.items() if k.startswith(prefix)}


class FilesystemFactory(TableFactory):
    connector = "filesystem"

    def validate(self, table: CatalogTable) -> None:
        if not table.options.get("path") or table.options.get("format") not in sinks.FORMATS:
            raise SQLQueryError("a filesystem table needs a path and a format of csv, json, parquet or text")

    def create_source(self, spark: SparkSession, table: CatalogTable) -> DataFrame:
        o = table.options
        streaming = o.get("streaming", "false").lower() == "true"
        reader = (spark.readStream if streaming else spark.read).format(o["format"]).options(**_prefixed(o, "source."))
        if o["format"] == "csv" and "source.header" not in o:
            reader = reader.option("header", "true")
        if table.ddl() and o["format"] != "text":
            reader = reader.schema(table.ddl())
        return reader.load(o["path"])

    def write(self, spark: SparkSession, table: CatalogTable, rows: DataFrame) -> Any:
        o = table.options
        known = {c.lower(): c for c in rows.columns}
        columns = [known.get(c.name.lower(), c.name) for c in table.columns] or None
        limit = o.get("sink.max-rows-per-file")
        return sinks.write_files(rows, o["path"], o["format"], columns=columns, mode=o.get("sink.mode", "append"), checkpoint=o.get("checkpoint"), max_rows_per_file=json.loads(limit) if limit else None)


class PrintFactory(TableFactory):
    connector = "print"

    def write(self, spark: SparkSession, table: CatalogTable, rows: DataFrame) -> Any:
        limit = int(table.options.get("limit", "20"))
        if rows.isStreaming:
            return rows.writeStream.format("console").option("numRows", limit).option("checkpointLocation", table.options["checkpoint"]).trigger(availableNow=True).start()
        return rows.show(limit, truncate=False)

    def supported_sink_row_kinds(self, table: CatalogTable) -> frozenset[str]:
        return ALL_KINDS


class KafkaFactory(TableFactory):
    connector = "kafka"

    def validate(self, table: CatalogTable) -> None:
        if not table.options.get("topic") or not table.options.get("bootstrap.servers"):
            raise SQLQueryError("a kafka table needs a topic and bootstrap.servers")

    def create_source(self, spark: SparkSession, table: CatalogTable) -> DataFrame:
        o = table.options
        return kafka.read_kafka(spark, o["topic"].split(","), o["bootstrap.servers"], trigger=o.get("trigger", "continuous"), start_offset=o.get("start-offset", "earliest"), value_format=o.get("format", "raw"), schema=table.ddl())

    def write(self, spark: SparkSession, table: CatalogTable, rows: DataFrame) -> Any:
        if "," in table.options["topic"] or table.options.get("format", "raw") != "raw":
            raise SQLQueryError("a kafka sink needs one topic and the raw format")
        return kafka.write_kafka(rows, table.options["topic"], table.options["bootstrap.servers"], key_field=table.options.get("key.field"), checkpoint=table.options.get("checkpoint"))


def default_factories() -> dict[str, TableFactory]:
    return {f.connector: f for f in (FilesystemFactory(), PrintFactory(), KafkaFactory())}
