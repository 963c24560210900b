"""The engine's operators on small inline inputs, and its queries against DuckDB."""

from __future__ import annotations

import json
import math
import os
import random
import sqlite3
import time
from collections import Counter

import duckdb
import pytest

from tidewright import KeyedProcessFunction, MapStateDescriptor, ResultOverflowError, SessionWindow, SlidingWindow, SQLQueryError, TumblingWindow, ValueStateDescriptor, pipeline
from tidewright import queries as engine_queries
from tidewright.errors import EngineError
from tidewright.functions import download, media
from tidewright.functions.ai import call_backend
from tidewright.operators.changelog import ROW_KIND, fold_aggregate, materialise
from tidewright.plans import ddl
from tidewright.plans.gate import check_streaming, gate
from tidewright.sources import custom
from tidewright.sources.canal import decode_canal
from tidewright.sources.kafka import decoded, encoded
from tidewright.streaming import changelog, run

SF = "/root/testdata/sf0.001"
BATCH = [n for n in engine_queries.queries() if not n.startswith(("stream_", "keyed_"))]


@pytest.fixture(scope="module")
def p(spark):
    run.use_rocksdb(spark)
    return pipeline(spark)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in (*engine_queries.TABLES,):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", [*BATCH, "stream_agg_retract", "stream_join_materialized", "stream_topn_materialized", "keyed_running_total"])
def test_query_matches_duckdb(spark, duck, name):
    df = engine_queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([_plain(r[c]) for c in columns]) for r in df.collect())
    found = duck.execute(engine_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([_plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_stream_join_of_growing_tables(spark, duck):
    got = engine_queries.queries()["stream_join_orders"](spark, SF).select("o_orderkey", "c_name").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(engine_queries.oracle_sql()["stream_join_orders"]).fetchall())


def test_null_logic_and_names(p):
    events = p.from_items([{"id": 1, "score": 5, "ok": True}, {"id": 2, "score": None, "ok": None}, {"id": 3, "score": 1, "ok": False}])
    rows = p.sql("SELECT id, score > 2 AND ok AS both, score > 2 OR ok AS one, id IN (1, NULL) AS inside FROM events").collect()
    assert [tuple(r) for r in sorted(rows)] == [(1, True, True, True), (2, None, None, None), (3, False, False, None)]
    with pytest.raises(SQLQueryError, match="twice"):
        p.sql("SELECT id, score AS id FROM events")
    with pytest.raises(SQLQueryError):
        p.sql("SELECT missing FROM events")
    assert events.sql("SELECT * FROM self WHERE score > 2").collect()[0]["id"] == 1
    assert len(p.sql("SELECT * FROM events a JOIN events b ON a.id = b.id").df.columns) == 6


def test_scalar_deviations(p):
    one = p.from_items([{"x": 7.9, "s": " \ta b\n", "n": -4.0}])
    r = one.sql("SELECT TRUNC(x) AS t, TRIM(s) AS s, 1.5 AS lit, CAST(x AS INT) AS i, CAST('1.25' AS DECIMAL) AS d, 5 / 2 AS q, CONCAT_WS('-', 'a', NULL, 'b') AS c FROM self").collect()[0]
    assert tuple(r) == (7, "a b", 1.5, 7, 1.25, 2.5, "a-b")
    with pytest.raises(Exception, match="negative"):
        one.sql("SELECT SQRT(n) AS s FROM self").collect()
    for bad in ("SELECT SHA2(s, 111) AS h FROM self", "SELECT LOG(3, x) AS l FROM self"):
        with pytest.raises(SQLQueryError):
            one.sql(bad)


@pytest.mark.parametrize("bad", ["", "SELECT 1; SELECT 2", "DELETE FROM t", "SELECT AI_CLASSIFY(x) FROM t", "SELECT id FROM t WHERE AI_EMBED(x) IS NULL", "SELECT COUNT(*), AI_GENERATE(x) FROM t", "SELECT id FROM t WHERE DOWNLOAD(u) IS NULL", "SELECT /*+ STATE_TTL('zz'='1h') */ a FROM t", "SELECT UPPER(AI_GENERATE(x)) FROM t"])
def test_gate_rejects(bad):
    with pytest.raises(SQLQueryError):
        gate(bad, media.NAMES)


def test_gate_hint_and_streaming_rules():
    g = gate("SELECT /*+ STATE_TTL('o'='1h', 'c'='2 d') */ o.a FROM t o JOIN u c ON o.a = c.a")
    assert g.state_ttl == {"o": 3_600_000, "c": 172_800_000} and "STATE_TTL" not in g.sql
    check_streaming("SELECT a FROM t ORDER BY a LIMIT 3")
    for bad in ("SELECT a FROM t ORDER BY a", "SELECT a FROM t LIMIT 3"):
        with pytest.raises(SQLQueryError):
            check_streaming(bad)


def test_ddl(p, tmp_path):
    made = ddl.parse("CREATE TEMPORARY TABLE IF NOT EXISTS t (id BIGINT NOT NULL, m MAP<STRING, INT>, d DECIMAL(10, 2)) WITH ('connector' = 'print', 'limit' = '3')")
    assert [(c.name, c.data_type, c.nullable) for c in made.table.columns] == [("id", "BIGINT", False), ("m", "MAP<STRING,INT>", True), ("d", "DECIMAL(10,2)", True)]
    for bad in ("CREATE TABLE t (a INT)", "CREATE TABLE t (a INT, A INT) WITH ('connector'='print')", "INSERT INTO t (a) SELECT 1", "CREATE TABLE t (a INT) WITH ('x'='y')", "CREATE TABLE a.b (a INT) WITH ('connector'='print')"):
        with pytest.raises(SQLQueryError):
            ddl.parse(bad)
    p.execute_sql(f"CREATE TABLE lines (id BIGINT, amount BIGINT) WITH ('connector'='filesystem', 'path'='{tmp_path}/x', 'format'='csv')")
    p.from_items([{"amount": 5, "id": 1}, {"amount": 6, "id": 2}]).owner.insert("lines", p.from_items([{"amount": 5, "id": 1}, {"amount": 6, "id": 2}]))
    assert sorted(tuple(r) for r in p.sql("SELECT id, amount FROM lines", tables={}).collect()) == [(1, 5), (2, 6)]
    changes = p.from_items([{"id": 1, "amount": 1, ROW_KIND: "+I"}])
    with pytest.raises(SQLQueryError, match="can't take"):
        p.insert("lines", changes)
    with pytest.raises(SQLQueryError):
        p.execute_sql("DROP TABLE absent")
    p.execute_sql("DROP TABLE IF EXISTS absent")
    p.execute_sql("DROP TABLE lines")


def test_functions_registry(p):
    def twice(x: int) -> int:
        return None if x is None else 2 * x

    p.register_scalar_function("twice", twice)
    items = p.from_items([{"a": 12}, {"a": None}])
    assert sorted((r["b"] for r in items.sql("SELECT twice(a) AS b FROM self").collect()), key=str) == [24, None]
    with pytest.raises(SQLQueryError, match="already"):
        p.register_scalar_function("TWICE", twice)
    with pytest.raises(SQLQueryError, match="built-in"):
        p.register_scalar_function("upper", twice)
    with pytest.raises(SQLQueryError, match="arguments"):
        items.sql("SELECT twice(a, a) AS b FROM self")
    p.drop_scalar_function("twice")


def test_ai_backend_batches_and_nulls(p):
    asked = []

    def backend(rows):
        asked.append(len(rows))
        return [r[0].upper() for r in rows]

    assert call_backend(backend, [("a",), (None,), ("b",), ("a",), ("c",)], 2) == ["A", None, "B", "A", "C"] and asked == [2, 1]
    p.register_ai_function("AI_GENERATE", lambda rows: [f"<{r[0]}>" for r in rows], batch_size=2, replace=True)
    got = p.from_items([{"id": 1, "t": "x"}, {"id": 2, "t": None}]).sql("SELECT id, AI_GENERATE(t) AS g FROM self").collect()
    assert sorted((r["id"], r["g"]) for r in got) == [(1, "<x>"), (2, None)]


def test_python_maps(p):
    s = p.from_items([{"id": i, "v": i * 10} for i in range(4)])

    async def slow(r):
        return {"id": r["id"], "w": r["v"] + 1}

    class Add:
        def __init__(self, n):
            self.n = n

        def __call__(self, r):
            return {"x": r["v"] + self.n}

    assert [r["w"] for r in s.map(slow, async_buffer_size=2).collect()] == [1, 11, 21, 31]
    assert [r["x"] for r in s.map(Add, fn_constructor_args=(5,)).collect()] == [5, 15, 25, 35]
    assert [r["x"] for r in s.map(lambda r: {"x": 10 // r["id"]}, schema="x bigint", ignore_errors=True).collect()] == [10, 5, 3]
    assert [r["id"] for r in s.filter(lambda rows: [r["id"] > 1 for r in rows], batch_size=3).collect()] == [2, 3]
    with pytest.raises(Exception, match="one boolean"):
        s.transform(lambda df: df.coalesce(1)).filter(lambda rows: [True], batch_size=3).collect()
    with pytest.raises(ResultOverflowError):
        s.collect(3)
    with pytest.raises(EngineError):
        s.take(True)
    union = s.union(p.from_items([{"id": 9, "other": "x"}])).collect()
    assert len(union) == 5 and union[-1]["other"] == "x"


def test_windows(p):
    rows = p.from_items([{"k": "a", "v": v, "ts": t} for v, t in ((1, 100), (2, 200), (4, 1200))]).with_event_time("ts")
    total = lambda w: sorted((r["window_start"], r["s"]) for r in rows.key_by("k").window(w).aggregate(s=__import__("pyspark.sql.functions", fromlist=["sum"]).sum("v")).collect())
    assert total(TumblingWindow(1000)) == [(0, 3), (1000, 4)]
    assert total(TumblingWindow(1000, 150)) == [(-850, 1), (150, 2), (1150, 4)]
    assert total(SlidingWindow(1000, 500)) == [(-500, 3), (0, 3), (500, 4), (1000, 4)]
    assert total(SlidingWindow(150, 1000)) == [(0, 1)]
    assert total(SessionWindow(100)) == [(100, 1), (200, 2), (1200, 4)]
    assert total(SessionWindow(101)) == [(100, 3), (1200, 4)]
    folded = rows.key_by("k").window(TumblingWindow(1000)).reduce(lambda a, b: {**b, "v": a["v"] * 10 + b["v"]}).collect()
    assert sorted(r["v"] for r in folded) == [4, 12]


def test_interval_join_bounds(p):
    left = p.from_items([{"key": "a", "left": 1, "ts": 100}, {"key": "a", "left": 2, "ts": 300}]).with_event_time("ts")
    right = p.from_items([{"key": "a", "right": t, "ts": t} for t in (89, 90, 105, 110, 111, 290, 310, 311)]).with_event_time("ts")
    got = left.interval_join(right, left_key="key", right_key="key", left_timestamp="event_time", right_timestamp="event_time", lower_bound=-10, upper_bound=10).collect()
    assert sorted((r["left_left"], r["right_right"]) for r in got) == [(1, 90), (1, 105), (1, 110), (2, 290), (2, 310)]


def _stream(spark, tmp_path, rows, schema):
    at = tmp_path / "in"
    at.mkdir(exist_ok=True)
    (at / f"{len(list(at.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return spark.readStream.schema(schema).json(str(at))


def test_changelog_aggregate(spark, p, tmp_path):
    rows = [{ROW_KIND: k, "g": "a", "v": v} for k, v in (("+I", 1e16), ("+I", 1.0), ("-D", 1e16), ("+I", 1e300), ("-D", 1e300))]
    stream = _stream(spark, tmp_path, rows, f"{ROW_KIND} string, g string, v double")
    out = run.drain(changelog.aggregate_changes(stream, ["g"], {"s": ("sum", "v"), "m": ("max", "v"), "n": ("count", None)}))
    assert [tuple(r) for r in materialise(out).collect()] == [("a", 1.0, 1.0, 1)]
    kinds = sorted(r[ROW_KIND] for r in out.collect())
    assert kinds == ["+I"] + ["+U"] * 4 + ["-U"] * 4
    assert fold_aggregate(spark.createDataFrame([("+I", "a", 12), ("+I", "a", 18), ("-D", "a", 12)], f"{ROW_KIND} string, g string, v int"), ["g"], {"s": "v"}).first()["s"] == 18


def test_changelog_aggregate_of_many_changes(spark, p, tmp_path):
    """Every row's change of one group, in seconds: no call of the state for each row."""
    rows = [(k, i) for i in range(20_000) for k in (("+I", "-D") if i % 2 else ("+I",))]
    stream = _stream(spark, tmp_path, [{ROW_KIND: k, "g": None, "v": i % 5_000, "d": i / 10} for k, i in rows], f"{ROW_KIND} string, g int, v bigint, d double")
    start = time.monotonic()
    out = run.drain(changelog.aggregate_changes(stream, ["g"], {"n": ("count", None), "s": ("sum", "d"), "low": ("min", "v"), "high": ("max", "v")}))
    took = time.monotonic() - start
    assert materialise(out).collect() == [(None, 10_000, math.fsum(i / 10 for i in range(0, 20_000, 2)), 0, 4_998)]
    assert Counter(r[ROW_KIND] for r in out.select(ROW_KIND).collect()) == {"+I": 1, "-U": len(rows) - 1, "+U": len(rows) - 1}
    assert took < 20


def test_changelog_aggregate_over_micro_batches(spark, p, tmp_path):
    """Extremes, sums and counts against a plain recomputation, after each micro-batch; groups that become empty are gone."""
    pick = random.Random(3)
    held, want = [], {}
    schema = f"{ROW_KIND} string, g string, v bigint, x double, t timestamp_ntz"
    for batch in range(3):
        rows = []
        for _ in range(300):
            if held and pick.random() < 0.5:
                rows.append({**held.pop(pick.randrange(len(held))), ROW_KIND: "-D"})
            else:
                held.append({ROW_KIND: "+I", "g": pick.choice("ab"), "v": pick.choice([None, pick.randint(-9, 9)]), "x": pick.choice([None, 0.1, "NaN", pick.random()]), "t": f"2024-01-0{pick.randint(1, 9)}T00:00:00"})
                rows.append(held[-1])
        rows += [{ROW_KIND: k, "g": "c", "v": 1, "x": 1.0, "t": "2024-01-01T00:00:00"} for k in ("-D", "+I", "-D", "-D")]
        _stream(spark, tmp_path, rows, schema)
        os.utime(tmp_path / "in" / f"{batch}.json", (1e9 + batch, 1e9 + batch))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    asked = {"n": ("count", None), "nv": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "hx": ("max", "x"), "mx": ("min", "x"), "sx": ("sum", "x"), "t": ("max", "t")}
    got = {r["g"]: r for r in materialise(run.drain(changelog.aggregate_changes(stream, ["g"], asked))).collect()}
    for g in "ab":
        mine = [r for r in held if r["g"] == g]
        v, x = [r["v"] for r in mine if r["v"] is not None], [float(r["x"]) for r in mine if r["x"] is not None]
        real = [y for y in x if y == y]
        want[g] = (g, len(mine), len(v), sum(v), min(v), max(v), math.nan if len(real) < len(x) else max(x), min(real), math.nan if len(real) < len(x) else math.fsum(x), max(r["t"] for r in mine))
    assert {g: repr((*tuple(r)[:-1], r["t"].isoformat())) for g, r in got.items()} == {g: repr(w) for g, w in want.items()}


def test_exact_sum():
    s = changelog.ExactSum()
    for v, sign in ((0.1, 1), (0.2, 1), (float("nan"), 1), (0.1, -1), (float("nan"), -1)):
        s.add(v, sign)
    assert changelog.ExactSum(s.text()).value() == 0.2


def test_changelog_join_and_topn(spark, tmp_path):
    rows = [{ROW_KIND: k, "id": i, "name": n} for k, i, n in (("+I", 1, "x"), ("+I", 2, "y"), ("+I", None, "z"), ("-D", 2, "y"))]
    left = _stream(spark, tmp_path, rows, f"{ROW_KIND} string, id bigint, name string")
    right = _stream(spark, tmp_path, [], f"{ROW_KIND} string, id bigint, name string").select(ROW_KIND, "id").withColumnRenamed("id", "other")
    got = materialise(run.drain(changelog.join_changes(left, right, ["id"], ["other"]))).collect()
    assert [tuple(r) for r in got] == [(1, "x", 1)]
    top = materialise(run.drain(changelog.top_n_changes(left, 2, "id", descending=True))).collect()
    assert sorted(r["name"] for r in top) == ["x", "z"]


class _Count(KeyedProcessFunction):
    states = (ValueStateDescriptor("n", "n bigint"), MapStateDescriptor("by", "k string", "n bigint"))

    def process(self, value, context):
        n, by = context.state(self.states[0]), context.state(self.states[1])
        n.value = (n.value or 0) + value["v"]
        by[value["t"]] = by.get(value["t"], 0) + 1
        return {"key": context.key, "total": n.value, "kinds": sum(1 for _ in by.items())}


def test_keyed_process(spark, p, tmp_path):
    stream = _stream(spark, tmp_path, [{"key": k, "v": v, "t": t} for k, v, t in (("a", 1, "x"), ("a", 2, "y"), ("b", 4, "x"))], "key string, v bigint, t string")
    out = p.stream(stream).key_by("key").process(_Count(), schema="key string, total bigint, kinds bigint", order="v").collect()
    assert sorted(tuple(r) for r in out) == [("a", 1, 1), ("a", 3, 2), ("b", 4, 1)]


def test_canal(spark):
    m = [{"type": "INSERT", "isDdl": False, "data": [{"id": "1", "n": "a"}]}, {"type": "UPDATE", "isDdl": False, "data": [{"id": "1", "n": "b"}], "old": [{"n": "a"}]}, {"type": "DELETE", "isDdl": False, "data": [{"id": "1", "n": "b"}]}, {"type": "ALTER", "isDdl": True, "sql": "alter"}]
    df = spark.createDataFrame([(json.dumps(x),) for x in m], "value string")
    got = [(r[ROW_KIND], r["n"]) for r in decode_canal(df, ["id", "n"]).collect()]
    assert got == [("+I", "a"), ("-U", "a"), ("+U", "b"), ("-D", "b")]
    assert decode_canal(df, ["id"], ddl_handling="emit").where(f"{ROW_KIND} = 'DDL'").count() == 1
    with pytest.raises(Exception, match="DDL"):
        decode_canal(df, ["id"], ddl_handling="fail").collect()
    with pytest.raises(EngineError):
        decode_canal(df, ["id"], ddl_handling="what")


def test_kafka_rows(spark):
    raw = spark.createDataFrame([("t", 0, 5, b"k", b'{"a": 1}', 1000, 0)], "topic string, partition int, offset bigint, key binary, value binary, ms bigint, timestampType int").selectExpr("topic", "partition", "offset", "key", "value", "timestamp_millis(ms) AS timestamp", "timestampType")
    r = decoded(raw, "json", "a bigint").first()
    assert r["a"] == 1 and r["__kafka_offset"] == 5 and r["__kafka_timestamp"] == 1000
    assert encoded(spark.createDataFrame([(1, None)], "a int, b string"), "a").first()["value"] == '{"a":1,"b":null}'


def test_sinks(p, tmp_path):
    s = p.from_items([{"id": i, "n": str(i)} for i in range(300)])
    at = str(tmp_path / "db.sqlite")
    sqlite3.connect(at).execute("CREATE TABLE t (id INT, n TEXT)").connection.commit()
    p.from_dataframe(s.df.coalesce(1)).write_sql("INSERT INTO t VALUES (?, ?)", lambda: sqlite3.connect(at, timeout=60))
    assert sqlite3.connect(at).execute("SELECT count(*), sum(id) FROM t").fetchone() == (300, 44850)
    with pytest.raises(EngineError, match="one column"):
        s.write_text(str(tmp_path / "t"))
    statements = p.statement_set().add(s.write_json, str(tmp_path / "j")).add(s.write_parquet, str(tmp_path / "p"), columns=["id"])
    statements.execute(shared=[s])
    assert p.spark.read.json(str(tmp_path / "j")).count() == 300 and p.spark.read.parquet(str(tmp_path / "p")).columns == ["id"]
    with pytest.raises(EngineError):
        p.statement_set().execute()


class _Numbers(custom.SourceFunction):
    def read(self, position):
        at = position["position"]
        end = min(at + 3, 7)
        return [{"n": i} for i in range(at, end)], {"position": end}


def test_custom_source(p):
    assert sorted(r["n"] for r in p.source(_Numbers, "n bigint", bounded=True).collect()) == list(range(7))


def test_download_policy(p, tmp_path):
    (tmp_path / "a").write_bytes(b"1234")
    (tmp_path / "b").write_bytes(b"1234567")
    policy = download.DownloadPolicy(max_bytes=4)
    assert download.download(f"file://{tmp_path}/a", policy) == b"1234" and download.download(f"file://{tmp_path}/b", policy) is None and download.download(None, policy) is None
    local = lambda host, port: [(0, 0, 0, "", ("127.0.0.1", port))]
    with pytest.raises(EngineError):
        policy.check("http://x.test/", resolve=local)
    with pytest.raises(EngineError):
        policy.check("ftp://x.test/")
    download.DownloadPolicy(allow_private=True).check("http://x.test/", resolve=local)
    p.download_policy = policy
    got = p.from_items([{"u": f"file://{tmp_path}/a"}, {"u": f"file://{tmp_path}/b"}]).sql("SELECT u, DOWNLOAD(u) AS d FROM self").collect()
    assert sorted(len(r["d"] or b"") for r in got) == [0, 4]


def test_media_headers(p):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x02"
    r = p.from_items([{"d": png}]).sql("SELECT IMAGE_FORMAT(d) AS f, IMAGE_WIDTH(d) AS w, IMAGE_HEIGHT(d) AS h FROM self").collect()[0]
    assert tuple(r) == ("PNG", 7, 5)
    with pytest.raises(EngineError):
        media.image_format(b"nothing")
    assert list(media.page_range(5, 2, 3)) == [1, 2]
