"""The registered queries of the engine's own operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import changelog as ops
from tidewright.operators.windows import SessionWindow, SlidingWindow, TumblingWindow
from tidewright.session import Pipeline, pipeline
from tidewright.sources.canal import decode_canal
from tidewright.streaming import changelog, run
from tidewright.streaming.keyed import KeyedProcessFunction, ValueStateDescriptor

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")

#: Queries whose text both engines run as it is.
SHARED_SQL = {
    "scan_parquet": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "project_expr": "SELECT o_orderkey, o_totalprice * 2 AS double_price, o_custkey + 1 AS next_cust, -o_custkey AS minus_cust, o_totalprice / 4 AS quarter FROM orders",
    "filter_compound": "SELECT event_id, user_id, value FROM events WHERE (value > 50 AND user_id < 1000) OR event_type = 'click' OR NOT (value IS NOT NULL)",
    "filter_in_like": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_name LIKE '%9' OR c_custkey BETWEEN 10 AND 20",
    "case_cast": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 END AS code, CAST(o_custkey AS STRING) AS cust, CAST(o_orderkey AS DOUBLE) AS keyd FROM orders",
    "join_inner_using": "SELECT o_orderkey, c_name, o_totalprice FROM orders o JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) c USING (o_custkey)",
    "join_inner_on": "SELECT o.o_orderkey AS o_orderkey, c.c_name AS c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_right": "SELECT c.c_custkey AS c_custkey, o.o_orderkey AS o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT s.s_suppkey AS s_suppkey, c.c_custkey AS c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_cross": "SELECT r.r_name AS r_name, n.n_name AS n_name FROM region r CROSS JOIN nation n",
    "join_chain3": "SELECT n.n_name AS n_name, r.r_name AS r_name, COUNT(*) AS n, CAST(ROUND(SUM(o.o_totalprice)) AS BIGINT) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    "join_null_keys": "SELECT a.id AS id, b.name AS name FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) a JOIN (SELECT CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_custkey END AS k, c_name AS name FROM customer) b ON a.k = b.k",
    "join_semi": "SELECT c_custkey, c_name FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_anti": "SELECT c_custkey, c_name FROM customer c LEFT ANTI JOIN orders o ON c.c_custkey = o.o_custkey",
    "agg_group": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 2) AS price, MIN(l_discount) AS least, MAX(l_tax) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_global": "SELECT COUNT(*) AS n, COUNT(value) AS n_value, ROUND(SUM(value), 2) AS total, ROUND(AVG(value), 4) AS mean, MIN(value) AS low, MAX(value) AS high FROM events",
    "agg_group_expr": "SELECT user_id % 7 AS bucket, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY user_id % 7",
    "agg_count_null": "SELECT event_type, COUNT(*) AS n, COUNT(CASE WHEN value > 50 THEN value END) AS n_high FROM events GROUP BY event_type",
    "agg_expression": "SELECT event_type, ROUND(SUM(value) / COUNT(*), 4) AS mean, COUNT(DISTINCT user_id) AS users FROM events GROUP BY event_type HAVING COUNT(*) > 1",
    "join_anti_some": "SELECT c_custkey, c_name FROM customer c LEFT ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000) o ON c.c_custkey = o.o_custkey",
    "except_offset": "SELECT k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders WHERE o_totalprice > 250000) ORDER BY k LIMIT 20 OFFSET 5",
    "filter_ilike": "SELECT p_partkey FROM part WHERE p_type ILIKE '%s%' OR p_name NOT LIKE '%a%'",
    "fn_arcs": "SELECT p_partkey, ROUND(ACOS(p_size / 100.0), 8) AS ac, ROUND(ASIN(p_size / 100.0), 8) AS si, ROUND(ATAN(p_size), 8) AS ta, ROUND(LOG(2, p_size), 8) AS l2, ROUND(LOG(10, p_size), 8) AS l10 FROM part",
    "recursive_cte": "WITH RECURSIVE c(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c WHERE n < 30) SELECT n, r_name FROM c JOIN region r ON c.n = r.r_regionkey",
    "group_only": "SELECT o_orderstatus FROM orders GROUP BY o_orderstatus",
    "order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "topn_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    "cte_chain": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), named AS (SELECT b.o_orderkey AS o_orderkey, c.c_mktsegment AS seg FROM big b JOIN customer c ON b.o_custkey = c.c_custkey) SELECT seg, COUNT(*) AS n FROM named GROUP BY seg",
    "union_all": "SELECT c_name AS name FROM customer UNION ALL SELECT s_name AS name FROM supplier",
    "set_operations": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier) UNION SELECT r_regionkey AS k FROM region",
    "window_over": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS place FROM orders",
    "fn_string": "SELECT p_partkey, LOWER(p_name) AS low, UPPER(p_brand) AS up, CAST(LENGTH(p_name) AS BIGINT) AS n, CONCAT(p_brand, '-', p_type) AS both_names, CONCAT_WS('/', p_brand, p_type) AS path, SUBSTRING(p_name, 2, 3) AS part, REPLACE(p_type, 'S', 'z') AS swapped, TRIM(p_name) AS trimmed, CONTAINS(p_name, 'a') AS has_a FROM part",
    "fn_numeric": "SELECT p_partkey, ABS(-p_size) AS a, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, ROUND(SQRT(p_retailprice), 6) AS s, ROUND(EXP(p_size / 50.0), 6) AS e, ROUND(LN(p_retailprice), 6) AS l, CAST(SIGN(p_size - 25) AS INT) AS sg, ROUND(POWER(p_size, 2), 3) AS p, ROUND(SIN(p_size) + COS(p_size) + TAN(p_size), 5) AS trig, ROUND(p_retailprice, 1) AS r, p_partkey % 7 AS m FROM part",
    "fn_null": "SELECT event_id, COALESCE(CASE WHEN value > 50 THEN value END, -1.0) AS v, NULLIF(event_type, 'click') AS t, GREATEST(user_id, 500) AS g, LEAST(user_id, 500) AS l FROM events",
    "in_subquery": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)",
}

#: Queries that the engines spell differently: (here, DuckDB).
PAIRED_SQL = {
    "fn_date": (
        "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, CAST(DATE_ADD(CAST(o_orderdate AS DATE), 10) AS STRING) AS later, CAST(DATE_SUB(CAST(o_orderdate AS DATE), 3) AS STRING) AS sooner, DATEDIFF(CAST(o_orderdate AS DATE), TO_DATE('1995-01-01')) AS days FROM orders",
        "SELECT o_orderkey, YEAR(o_orderdate)::INT AS y, MONTH(o_orderdate)::INT AS m, DAY(o_orderdate)::INT AS d, (o_orderdate::DATE + 10)::VARCHAR AS later, (o_orderdate::DATE - 3)::VARCHAR AS sooner, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::INT AS days FROM orders",
    ),
    "fn_json": ("SELECT event_id, CAST(GET_JSON_OBJECT(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
    "fn_array_map": ("SELECT p_partkey, ARRAY_SIZE(ARRAY(p_size, 1, 2)) AS n, MAP('size', p_size)['size'] AS size, TO_JSON(ARRAY(p_size, 1)) AS js FROM part", "SELECT p_partkey, 3::INT AS n, p_size AS size, '[' || p_size || ',1]' AS js FROM part"),
    "fn_hash": ("SELECT p_partkey, MD5(p_name) AS m, SHA2(p_name, 256) AS s, BASE64(CAST(p_brand AS BINARY)) AS b, CAST(UNBASE64(BASE64(CAST(p_brand AS BINARY))) AS STRING) AS back FROM part", "SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s, base64(p_brand::BLOB) AS b, p_brand AS back FROM part"),
    "fn_trunc_cast": ("SELECT p_partkey, TRUNC(p_retailprice) AS t, CAST(p_size AS DECIMAL) AS d, IF(p_size > 10, 'big', 'small') AS s FROM part", "SELECT p_partkey, trunc(p_retailprice)::BIGINT AS t, p_size::DOUBLE AS d, CASE WHEN p_size > 10 THEN 'big' ELSE 'small' END AS s FROM part"),
    "fn_floor_mod": (
        "SELECT event_id, (event_id - 500) % 7 AS a, -event_id % 3 AS b, event_id * 3 % -5 AS c, user_id - event_id % 4 AS d FROM events",
        "SELECT event_id, (event_id - 500) - 7 * floor((event_id - 500) / 7)::BIGINT AS a, -event_id - 3 * floor(-event_id / 3)::BIGINT AS b, event_id * 3 + 5 * floor(event_id * 3 / -5)::BIGINT AS c, user_id - event_id % 4 AS d FROM events",
    ),
    "fn_string_edges": (
        "SELECT p_partkey, SUBSTRING(p_brand, -30, 4) AS head, SUBSTRING(p_brand, -3, 2) AS tail, TRIM(CONCAT(' \t', p_name, ' \n ')) AS trimmed, STARTSWITH(p_name, 'a') AS s, ENDSWITH(p_name, 'e') AS e, CONTAINS(p_name, 'b') AS c, LENGTH(CONCAT('  ', p_name)) AS n FROM part",
        "SELECT p_partkey, p_brand[:4] AS head, substr(p_brand, -3, 2) AS tail, trim(p_name) AS trimmed, starts_with(p_name, 'a') AS s, ends_with(p_name, 'e') AS e, contains(p_name, 'b') AS c, (length(p_name) + 2)::INT AS n FROM part",
    ),
    "fn_json_scalars": (
        "SELECT event_id, TO_JSON(event_id) AS i, TO_JSON(event_type) AS s, TO_JSON(NULLIF(event_type, 'click')) AS z, GET_JSON_OBJECT(TO_JSON(PARSE_JSON(props)), '$.k') AS k FROM events",
        "SELECT event_id, event_id::VARCHAR AS i, '\"' || event_type || '\"' AS s, '\"' || nullif(event_type, 'click') || '\"' AS z, json_extract_string(props, '$.k') AS k FROM events",
    ),
    "scalar_select": ("SELECT 1 + 2 AS three, 'x' AS x", "SELECT 3::INT AS three, 'x' AS x"),
}


def _engine(spark: SparkSession, sf_dir: str, *tables: str) -> Pipeline:
    p = pipeline(spark)
    for t in tables or TABLES:
        p.create_temp_view(t, p.read.read_parquet(f"{sf_dir}/{t}.parquet"))
    return p


def _sql(text: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = [t for t in TABLES if t in text]
    return lambda spark, sf_dir: _engine(spark, sf_dir, *tables).sql(text, tables={}).df


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("event_time", F.col("ts").cast("timestamp"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    return stream.withColumn("event_time", F.col("ts").cast("timestamp"))




def _windowed(assigner) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pipeline(spark)
        return p.from_dataframe(_events(spark, sf_dir)).key_by("event_type").window(assigner).aggregate(n=F.count("*"), total=F.round(F.sum("value"), 2)).df

    return query


def window_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python fold of each window's rows."""
    p = pipeline(spark)
    rows = p.from_dataframe(_events(spark, sf_dir).select("event_type", "event_time", "event_id", F.lit(1).cast("bigint").alias("n")))
    return rows.key_by("event_type").window(TumblingWindow("1 d")).reduce(lambda a, b: {**b, "n": a["n"] + b["n"]}).df.select("event_type", "event_id", "n")


def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _engine(spark, sf_dir, "events")

    def band(value: float) -> str:
        return "none" if value is None else "high" if value > 50 else "low"

    p.register_scalar_function("band", band)
    return p.sql("SELECT event_id, band(value) AS band FROM events", tables={}).df


def udf_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _engine(spark, sf_dir, "orders")

    def digits(key: int) -> int:
        return sum(map(int, str(key)))

    return p.sql("SELECT digits(o_custkey) AS d, COUNT(*) AS n, SUM(digits(o_orderkey)) AS total FROM orders GROUP BY digits(o_custkey)", tables={}, functions={"digits": digits}).df


def ai_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in backend: counts of vowels."""
    p = _engine(spark, sf_dir, "documents")

    def backend(rows: list[tuple]) -> list[list[float]]:
        return [[float(r[0].count(v)) for v in "aeiou"] for r in rows]

    p.register_ai_function("AI_EMBED", backend)
    df = p.sql("SELECT doc_id, AI_EMBED(text) AS e FROM documents", tables={}).df
    return df.select("doc_id", F.expr("aggregate(e, 0D, (a, x) -> a + x)").cast("bigint").alias("vowels"))


def map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _engine(spark, sf_dir, "orders")
    return p.views["orders"].select("o_orderkey", "o_custkey").map(lambda r: {"k": r["o_orderkey"] * 2, "even": r["o_custkey"] % 2 == 0}, schema="k bigint, even boolean").filter(lambda r: r["even"]).df


def flat_map_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _engine(spark, sf_dir, "part")
    words = p.views["part"].select("p_partkey", "p_name").flat_map(lambda r: [{"w": w} for w in r["p_name"].split(" ")], schema="w string")
    return words.df.groupBy("w").agg(F.count("*").alias("n"))


def map_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _engine(spark, sf_dir, "embeddings")

    def norm(batch: dict) -> dict:
        x = np.stack([np.asarray(v, np.float64) for v in batch["embedding"]])
        return {"vec_id": batch["vec_id"], "milli": np.floor((x * x).sum(axis=1) * 1000 + 0.5).astype("int64")}

    return p.views["embeddings"].map_batches(norm, batch_size=256, schema="vec_id bigint, milli bigint").df


def map_reduce_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document, measured in batches, joined again in order."""
    p = _engine(spark, sf_dir, "documents")
    split = lambda r: [{"line": x, "n": None} for x in r["text"].split("\n")]
    measure = lambda rows: [{"line": r["line"], "n": len(r["line"])} for r in rows]
    join = lambda d: {"lines": len(d["n"]), "chars": sum(d["n"]), "first": d["n"][0]}
    return p.views["documents"].select("doc_id", "text").map_reduce("doc_id", split, measure, join, middle="line string, n bigint", schema="lines bigint, chars bigint, first bigint", batch_process_size=64).df


def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases within an hour after a click of the same user."""
    p = pipeline(spark)
    e = _events(spark, sf_dir).select("event_id", "user_id", "event_type", "event_time")
    kinds = [r[0] for r in e.select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    left, right = (p.from_dataframe(e.where(F.col("event_type") == k).drop("event_type")) for k in kinds)
    joined = left.interval_join(right, left_key="user_id", right_key="user_id", left_timestamp="event_time", right_timestamp="event_time", lower_bound=0, upper_bound="6 h")
    return joined.df.select(F.col("left_event_id").alias("a"), F.col("right_event_id").alias("b"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a file stream in update mode; each window's last update counts."""
    rows = _event_stream(spark, sf_dir).withWatermark("event_time", "7 days")
    counts = rows.groupBy(F.window("event_time", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    flat = counts.select("event_type", F.unix_millis("w.start").alias("window_start"), "n")
    return run.drain(flat, "complete").groupBy("event_type", "window_start").agg(F.max("n").alias("n"))


def stream_agg_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    run.use_rocksdb(spark)
    rows = _event_stream(spark, sf_dir).select("event_type", "user_id", "value")
    changes = changelog.aggregate_changes(rows, ["event_type"], {"n": ("count", None), "users_sum": ("sum", "user_id"), "low": ("min", "value"), "high": ("max", "value")}, retractable=False)
    return ops.materialise(run.drain(changes))


def stream_agg_retract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of odd ids are added and taken off again; only the even ones count in the end."""
    run.use_rocksdb(spark)
    rows = _event_stream(spark, sf_dir).select("event_type", "event_id", "user_id", "value")
    kinds = F.when(F.col("event_id") % 2 == 1, F.array(F.lit("+I"), F.lit("-D"))).otherwise(F.array(F.lit("+I")))
    rows = rows.withColumn(ops.ROW_KIND, F.explode(kinds))
    changes = changelog.aggregate_changes(rows.drop("event_id"), ["event_type"], {"n": ("count", None), "users_sum": ("sum", "user_id"), "low": ("min", "value"), "high": ("max", "value")})
    return ops.materialise(run.drain(changes))


def stream_join_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    run.use_rocksdb(spark)
    table = lambda t: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{t}.parquet").schema).parquet(f"{sf_dir}/{t}.parquet*")
    nations, regions = table("nation").select("n_nationkey", "n_name", "n_regionkey"), table("region").select("r_regionkey", "r_name")
    changes = changelog.join_changes(nations, regions, ["n_regionkey"], ["r_regionkey"])
    return ops.materialise(run.drain(changes)).select("n_name", "r_name")


def stream_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog join over tables that grow: the orders of a customer gather under one key."""
    run.use_rocksdb(spark)
    table = lambda t: spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{t}.parquet").schema).parquet(f"{sf_dir}/{t}.parquet*")
    orders, customers = table("orders").select("o_orderkey", "o_custkey"), table("customer").select("c_custkey", "c_name")
    changes = changelog.join_changes(orders, customers, ["o_custkey"], ["c_custkey"])
    return ops.materialise(run.drain(changes)).select("o_orderkey", "c_name")


def _continuous(text: str, *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    """SQL over file streams; the table that its changes amount to."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = pipeline(spark)
        for t in tables:
            schema = spark.read.parquet(f"{sf_dir}/{t}.parquet").schema
            p.create_temp_view(t, p.stream(spark.readStream.schema(schema).parquet(f"{sf_dir}/{t}.parquet*")))
        return p.sql(text, tables={}).materialise().df

    return query


#: Continuous SQL: (text, tables); DuckDB runs the same text without hints.
CONTINUOUS_SQL = {
    "stream_sql_agg": ("SELECT event_type, COUNT(*) AS n, SUM(user_id) AS users_sum, MIN(value) AS low, MAX(value) AS high, ROUND(AVG(value), 4) AS mean FROM events WHERE value > 5 GROUP BY event_type HAVING COUNT(*) > 1", ("events",)),
    "stream_sql_join": ("SELECT n.n_name AS n_name, s.s_name AS s_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s_acctbal > 0 AND n_regionkey BETWEEN 1 AND 3", ("supplier", "nation")),
    "stream_sql_topn": ("SELECT event_id, value FROM events WHERE user_id % 2 = 0 ORDER BY value DESC, event_id LIMIT 10", ("events",)),
    "stream_sql_ttl": ("SELECT /*+ STATE_TTL('c' = '1 d', 'n' = '2 d') */ n.n_name AS n_name, COUNT(*) AS n, ROUND(MAX(c.c_acctbal), 2) AS most FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY n DESC, n_name LIMIT 6", ("customer", "nation")),
}


def stream_topn_materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    run.use_rocksdb(spark)
    rows = _event_stream(spark, sf_dir).select("event_id", (F.col("value") * 1000000 + F.col("event_id")).alias("score"))
    changes = changelog.top_n_changes(rows, 10, "score", descending=True, retractable=False)
    return ops.materialise(run.drain(changes)).select("event_id")


class _RunningTotal(KeyedProcessFunction):
    states = (ValueStateDescriptor("total", "t double"),)

    def process(self, value: dict, context) -> dict:
        total = context.state(self.states[0])
        total.value = (total.value or 0.0) + (value["value"] or 0.0)
        return {"event_id": value["event_id"], "user_id": value["user_id"], "total": round(total.value, 2)}


def keyed_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    run.use_rocksdb(spark)
    p = pipeline(spark)
    rows = p.from_dataframe(_event_stream(spark, sf_dir).select("event_id", "user_id", "value"))
    out = rows.key_by("user_id").process(_RunningTotal(), schema="event_id bigint, user_id bigint, total double", order="event_id")
    return run.drain(out.df)


def canal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as change messages: inserted, a third renamed, a fifth deleted; the table that remains."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    row = lambda name: F.create_map(F.lit("id"), F.col("id"), F.lit("name"), name)
    message = lambda kind, data, old=None: F.to_json(F.struct(F.lit(kind).alias("type"), F.lit(False).alias("isDdl"), F.array(data).alias("data"), *([F.array(old).alias("old")] if old is not None else [])))
    new_name = F.concat("name", F.lit("*"))
    third, fifth = F.col("id").cast("int") % 3 == 0, F.col("id").cast("int") % 5 == 0
    messages = c.select(message("INSERT", row(F.col("name"))).alias("value"))
    messages = messages.union(c.where(third).select(message("UPDATE", row(new_name), F.create_map(F.lit("name"), F.col("name")))))
    messages = messages.union(c.where(fifth).select(message("DELETE", row(F.when(third, new_name).otherwise(F.col("name"))))))
    return ops.materialise(decode_canal(messages, ["id", "name"], include_metadata=False))


def files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE TABLE, INSERT INTO a JSON table below the shared folder, and a query over it."""
    p = _engine(spark, sf_dir, "nation")
    at = run.checkpoint_location(spark, "nations")
    p.execute_sql(f"CREATE TABLE out_nations (n_nationkey BIGINT, n_name STRING) WITH ('connector' = 'filesystem', 'path' = '{at}', 'format' = 'json')")
    p.execute_sql("INSERT INTO out_nations SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
    return p.sql("SELECT n_nationkey, n_name FROM out_nations", tables={}).df


_PYTHON: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "window_tumbling": (_windowed(TumblingWindow("1 h")), "SELECT event_type, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT + 3600000 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"),
    "window_sliding": (
        _windowed(SlidingWindow("2 h", "1 h")),
        "SELECT event_type, s AS window_start, s + 7200000 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest([epoch_ms(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT, epoch_ms(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT - 3600000]) AS s FROM events) GROUP BY ALL",
    ),
    "window_gaps": (_windowed(SlidingWindow("1 h", "3 h")), "SELECT event_type, s AS window_start, s + 3600000 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, epoch_ms(ts)::BIGINT AS t, epoch_ms(ts)::BIGINT // 10800000 * 10800000 AS s FROM events) WHERE t - s < 3600000 GROUP BY ALL"),
    "window_session": (
        _windowed(SessionWindow("30 min")),
        "WITH o AS (SELECT event_type, value, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT event_type, epoch_us(min(ts))::BIGINT // 1000 AS window_start, epoch_us(max(ts) + INTERVAL 30 MINUTE)::BIGINT // 1000 AS window_end, count(*) AS n, round(sum(value), 2) AS total FROM g GROUP BY event_type, s",
    ),
    "window_reduce": (window_reduce, "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY event_type, ts::DATE"),
    "udf_scalar": (udf_scalar, "SELECT event_id, CASE WHEN value IS NULL THEN 'none' WHEN value > 50 THEN 'high' ELSE 'low' END AS band FROM events"),
    "udf_group": (udf_group, "WITH d AS (SELECT list_sum(list_transform(string_split(o_custkey::VARCHAR, ''), lambda x: x::INT))::BIGINT AS d, list_sum(list_transform(string_split(o_orderkey::VARCHAR, ''), lambda x: x::INT))::BIGINT AS k FROM orders) SELECT d, count(*) AS n, sum(k)::BIGINT AS total FROM d GROUP BY d"),
    "ai_embed": (ai_embed, "SELECT doc_id, length(regexp_replace(text, '[^aeiou]', '', 'g'))::BIGINT AS vowels FROM documents"),
    "map_rows": (map_rows, "SELECT o_orderkey * 2 AS k, true AS even FROM orders WHERE o_custkey % 2 = 0"),
    "flat_map_tokens": (flat_map_tokens, "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w"),
    "map_batches": (map_batches, "SELECT vec_id, floor(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 1000 + 0.5)::BIGINT AS milli FROM embeddings"),
    "map_reduce_docs": (map_reduce_docs, "SELECT len(l)::BIGINT AS lines, list_sum(list_transform(l, lambda x: length(x)))::BIGINT AS chars, length(l[1])::BIGINT AS first FROM (SELECT string_split(text, chr(10)) AS l FROM documents)"),
    "interval_join": (interval_join, "WITH k AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = (SELECT min(event_type) FROM k) AND b.event_type = (SELECT max(event_type) FROM k)"),
    "stream_tumbling": (stream_tumbling, "SELECT event_type, epoch_ms(ts::DATE::TIMESTAMP)::BIGINT AS window_start, count(*) AS n FROM events GROUP BY ALL"),
    "stream_agg_materialized": (stream_agg_materialized, "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users_sum, min(value) AS low, max(value) AS high FROM events GROUP BY event_type"),
    "stream_agg_retract": (stream_agg_retract, "SELECT event_type, count(*) AS n, sum(user_id)::BIGINT AS users_sum, min(value) AS low, max(value) AS high FROM events WHERE event_id % 2 = 0 GROUP BY event_type"),
    "stream_join_materialized": (stream_join_materialized, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "stream_join_orders": (stream_join_orders, "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "stream_topn_materialized": (stream_topn_materialized, "SELECT event_id FROM events ORDER BY value * 1000000 + event_id DESC LIMIT 10"),
    "keyed_running_total": (keyed_running_total, "SELECT event_id, user_id, round(sum(coalesce(value, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events"),
    "canal_replay": (canal_replay, "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '*' ELSE c_name END AS name FROM customer WHERE c_custkey % 5 <> 0"),
    "files_round_trip": (files_round_trip, "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {n: _sql(t) for n, t in SHARED_SQL.items()} | {n: _sql(t) for n, (t, _) in PAIRED_SQL.items()}
    out |= {n: _continuous(t, *tables) for n, (t, tables) in CONTINUOUS_SQL.items()}
    return out | {n: f for n, (f, _) in _PYTHON.items()}


def oracle_sql() -> dict[str, str]:
    shared = {n: t.replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN") for n, t in SHARED_SQL.items()}
    shared |= {n: re.sub(r"/\*\+.*?\*/", "", t) for n, (t, _) in CONTINUOUS_SQL.items()}
    return shared | {n: t for n, (_, t) in PAIRED_SQL.items()} | {n: t for n, (_, t) in _PYTHON.items() if t}
