"""Canal change messages: JSON of inserts, updates and deletes to a changelog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.errors import EngineError
from tidewright.operators.changelog import ROW_KIND

_ROW = "map<string,string>"
_MESSAGE = f"type string, isDdl boolean, database string, table string, sql string, es bigint, ts bigint, pkNames array<string>, data array<{_ROW}>, old array<{_ROW}>"


def decode_canal(messages: DataFrame, columns: list[str], value: str = "value", ddl_handling: str = "ignore", include_metadata: bool = True) -> DataFrame:
    """Messages to rows: INSERT ``+I``, DELETE ``-D``, UPDATE ``-U`` (the row overlaid by its old values) and ``+U``.

    Values stay strings.  Bad JSON fails.  DDL is ignored, emitted (kind ``DDL``, no data) or an error.
    """
    if ddl_handling not in ("ignore", "emit", "fail"):
        raise EngineError(f"unknown ddl_handling {ddl_handling!r}")
    m = messages.withColumn("_m", F.from_json(F.col(value).cast("string"), _MESSAGE, {"mode": "FAILFAST"}))
    if ddl_handling == "fail":
        checked = F.when(F.coalesce("_m.isDdl", F.lit(False)), F.raise_error(F.lit("a DDL message arrived")).cast("boolean")).otherwise(F.lit(True))
        m = m.where(checked)
    kind = F.upper("_m.type")
    data, old = F.coalesce("_m.data", F.array().cast(f"array<{_ROW}>")), F.coalesce("_m.old", F.array().cast(f"array<{_ROW}>"))
    entry = lambda k, row: F.struct(F.lit(k).alias("k"), row.alias("row"))
    before = lambda new, i: F.map_concat(F.map_filter(new, lambda k, _: ~F.map_contains_key(F.coalesce(F.get(old, i), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), k)), F.coalesce(F.get(old, i), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    rows = (
        F.when(kind == "INSERT", F.transform(data, lambda r: entry("+I", r)))
        .when(kind == "DELETE", F.transform(data, lambda r: entry("-D", r)))
        .when(kind == "UPDATE", F.flatten(F.transform(data, lambda r, i: F.array(entry("-U", before(r, i)), entry("+U", r)))))
    )
    if ddl_handling == "emit":
        rows = F.when(F.coalesce("_m.isDdl", F.lit(False)), F.array(F.struct(F.lit("DDL").alias("k"), F.lit(None).cast(_ROW).alias("row")))).otherwise(rows)
    else:
        rows = F.when(F.coalesce("_m.isDdl", F.lit(False)), None).otherwise(rows)
    out = m.withColumn("_r", F.explode(rows))
    meta = {"__canal_database": "_m.database", "__canal_table": "_m.table", "__canal_type": "_m.type", "__canal_ts": "_m.ts", "__canal_es": "_m.es", "__canal_pk_names": "_m.pkNames", "__canal_sql": "_m.sql"} if include_metadata else {}
    return out.select(*(F.try_element_at(F.col("_r.row"), F.lit(c)).alias(c) for c in columns), *(F.col(p).alias(n) for n, p in meta.items()), F.col("_r.k").alias(ROW_KIND))
