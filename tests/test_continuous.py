"""Continuous SQL, function binding, Python maps and rewritten functions."""

from __future__ import annotations

import json

import pytest

from tidewright import SQLQueryError, ValueStateDescriptor, KeyedProcessFunction, pipeline
from tidewright.operators.changelog import ALL_KINDS, INSERT_ONLY, ROW_KIND
from tidewright.plans.gate import gate
from tidewright.streaming import changelog, run
from tidewright.streaming.keyed import StateTtl


@pytest.fixture(scope="module")
def p(spark):
    run.use_rocksdb(spark)
    return pipeline(spark)


def _stream(p, at, rows, schema):
    at.mkdir(exist_ok=True, parents=True)
    (at / "0.json").write_text("\n".join(json.dumps(r) for r in rows))
    return p.stream(p.spark.readStream.schema(schema).json(str(at)))


def _rows(stream):
    return sorted(map(tuple, stream.materialise().collect()), key=str)


def test_joins_aggregates_and_top_n_over_changes(p, tmp_path):
    orders = _stream(p, tmp_path / "o", [{ROW_KIND: k, "id": i, "amount": a} for k, i, a in (("+I", 1, 10), ("+I", 1, 15), ("+I", 2, 7), ("+I", None, 99), ("-D", 1, 10), ("+I", 3, 1))], f"{ROW_KIND} string, id bigint, amount bigint")
    names = _stream(p, tmp_path / "c", [{"id": 1, "name": "Ada"}, {"id": 2, "name": "Lin"}, {"id": None, "name": "-"}], "id int, name string")
    tables = {"orders": orders, "customers": names}
    total = p.sql("SELECT name, SUM(amount) AS total, COUNT(*) AS n FROM orders o JOIN customers c ON o.id = c.id GROUP BY name", tables=tables)
    assert total.kinds == ALL_KINDS and _rows(total) == [("Ada", 15, 1), ("Lin", 7, 1)]
    using = p.sql("SELECT id, amount, name FROM orders JOIN customers USING (id) WHERE amount > 8", tables=tables)
    assert using.kinds == frozenset({"+I", "-D"}) and _rows(using) == [(1, 15, "Ada")]
    top = p.sql("SELECT o.*, amount * 2 AS twice FROM orders o ORDER BY amount DESC LIMIT 2", tables=tables)
    assert _rows(top) == [(1, 15, 30), (None, 99, 198)]


def test_changing_streams_are_labelled(p, tmp_path):
    rows = _stream(p, tmp_path / "r", [{"g": "a", "v": 1}, {"g": "a", "v": 2}], "g string, v int")
    counts = p.sql("SELECT g, COUNT(*) AS n FROM rows GROUP BY g", tables={"rows": rows})
    plain = p.sql("SELECT g, v + 1 AS w FROM rows WHERE v > 1", tables={"rows": rows})
    assert counts.kinds == ALL_KINDS and ROW_KIND in counts.df.columns and plain.kinds == INSERT_ONLY
    p.execute_sql(f"CREATE TABLE files (g STRING, n BIGINT) WITH ('connector'='filesystem', 'path'='{tmp_path}/x', 'format'='json')")
    with pytest.raises(SQLQueryError, match="can't take"):
        p.insert("files", counts)
    p.execute_sql("DROP TABLE files")
    # one micro-batch of insert-only rows gives one change for each group
    assert [r[ROW_KIND] for r in counts.collect()] == ["+I"]


@pytest.mark.parametrize("bad", ["SELECT g FROM rows LEFT JOIN more ON rows.g = more.g", "SELECT g FROM rows JOIN more ON rows.v > more.v", "SELECT COUNT(DISTINCT v) AS n FROM rows", "SELECT v AS a, v + 1 AS a, COUNT(*) AS n FROM rows GROUP BY v", "SELECT /*+ STATE_TTL('g'='1h') */ g, COUNT(*) AS n FROM rows GROUP BY g", "SELECT g FROM rows JOIN more ON rows.g = more.g", "SELECT /*+ STATE_TTL('rows'='1h') */ g FROM rows", "SELECT missing, COUNT(*) AS n FROM rows GROUP BY missing"])
def test_continuous_queries_that_cannot_be_planned(p, tmp_path, bad):
    rows, more = (_stream(p, tmp_path / n, [], "g string, v int") for n in ("a", "b"))
    with pytest.raises(SQLQueryError):
        p.sql(bad, tables={"rows": rows, "more": more})


def test_aggregates_of_every_type(p, tmp_path):
    rows = [{"g": 1, "d": "1.1", "f": 1.5, "t": "2024-01-01T00:00:00.000001"}, {"g": 1, "d": "2.2", "f": "NaN", "t": "2024-01-02T00:00:00"}, {"g": 1}, {"g": None, "f": 2.0}]
    stream = _stream(p, tmp_path / "t", rows, "g int, d decimal(10,1), f double, t timestamp_ntz")
    got = {r["g"]: r for r in p.sql("SELECT g, SUM(d) AS s, MAX(d) AS m, MIN(f) AS lo, MAX(f) AS hi, AVG(f) AS a, MAX(t) AS t, COUNT(d) AS n FROM self GROUP BY g", tables={"self": stream}).materialise().collect()}
    assert str(got[1]["s"]) == "3.3" and str(got[1]["m"]) == "2.2" and got[1]["lo"] == 1.5 and got[1]["hi"] != got[1]["hi"] and got[1]["a"] != got[1]["a"]
    assert got[1]["t"].day == 2 and got[1]["n"] == 2 and got[None]["s"] is None and got[None]["a"] == 2.0 and got[None]["n"] == 0
    retracted = changelog.aggregate_changes(stream.df, ["g"], {"s": ("sum", "d"), "m": ("min", "d"), "t": ("min", "t")})
    by = {r["g"]: r for r in run.drain(retracted).where(f"{ROW_KIND} in ('+I', '+U')").collect()}
    assert str(by[1]["m"]) in ("1.1", "2.2") and by[1]["t"].day in (1, 2)


class _Seen(KeyedProcessFunction):
    states = (ValueStateDescriptor("n", "n bigint", StateTtl("1 h")),)

    def process(self, value, context):
        n = context.state(self.states[0])
        n.value = (n.value or 0) + 1
        return {"k": context.key, "n": n.value}


def test_keyed_state_that_expires(p, tmp_path):
    stream = _stream(p, tmp_path / "k", [{"k": "a"}, {"k": "a"}, {"k": "b"}], "k string")
    assert sorted(map(tuple, stream.key_by("k").process(_Seen(), schema="k string, n bigint").collect())) == [("a", 1), ("a", 2), ("b", 1)]


def test_functions_in_literals_and_names(p):
    items = p.from_items([{"a": 1, "orders": 5}])
    p.register_scalar_function("band", lambda x: f"b{x}", return_type="string", replace=True)
    row = items.sql("SELECT 'band (a)' AS s, band(a) AS b, orders FROM self -- band(a)\n").collect()[0]
    assert tuple(row) == ("band (a)", "b1", 5)
    p.drop_scalar_function("band")
    # a table named like a column isn't opened
    p.execute_sql("CREATE TABLE orders (x INT) WITH ('connector'='filesystem', 'path'='/nowhere/at/all', 'format'='json')")
    assert items.sql("SELECT orders FROM self").collect()[0][0] == 5
    p.execute_sql("DROP TABLE orders")


class _Counting:
    def __init__(self, at):
        self.at = at
        with open(at, "a") as f:
            f.write("x")

    def __call__(self, r):
        return {"id": r["id"]}


def test_classes_are_built_once_a_task(p, spark, tmp_path):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = p.stream(spark.range(0, 100, 1, 2))
        at = tmp_path / "built"
        assert len(rows.map(_Counting, fn_constructor_args=(str(at),), schema="id bigint").collect()) == 100
        assert at.read_text() == "xx"
        sizes = rows.map_batches(lambda b: {"n": [len(b["id"])]}, batch_size=25, schema="n bigint").collect()
        assert sorted(r["n"] for r in sizes) == [25, 25, 25, 25]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_coroutines_and_errors(p):
    async def inverse(r):
        return {"x": 10 // r["id"]}

    rows = p.from_items([{"id": i} for i in range(4)])
    assert [r["x"] for r in rows.map(inverse, schema="x bigint", ignore_errors=True, async_buffer_size=2).collect()] == [10, 5, 3]
    with pytest.raises(Exception, match="by zero"):
        rows.map(inverse, schema="x bigint").collect()


def test_rewritten_functions(p):
    one = p.from_items([{"x": -7, "s": "Small"}])
    assert tuple(one.sql("SELECT x % 3 AS a, 7 % -3 AS b, SUBSTRING(s, -8, 4) AS c, TO_JSON(1) AS d, TO_JSON(s) AS e, TO_JSON(ARRAY(1, 2)) AS f FROM self").collect()[0]) == (2, -2, "Smal", "1", '"Small"', "[1,2]")
    assert one.sql("SELECT CASE WHEN x % 4 = 1 THEN -x % 4 ELSE ABS(x % 4) END % 2 AS y FROM self").collect()[0][0] == 1
    assert one.sql("SELECT x FROM self WHERE (x) % 2 = 1 AND NOT x % 5 = 0 AND 9 - 5 % 3 = 7").collect()[0][0] == -7
    with pytest.raises(SQLQueryError):
        gate("SELECT GET_JSON_OBJECT(s, 'k..') AS k FROM t")
    with pytest.raises(SQLQueryError):
        one.sql("SELECT 1 / (x + 7) AS d FROM self").collect()
