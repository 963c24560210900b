"""The pipeline: tables, views, functions and SQL over one Spark session."""

from __future__ import annotations

import inspect
import re
import uuid
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.errors import EngineError, SQLQueryError
from tidewright.functions import ai, download, media
from tidewright.operators.changelog import ALL_KINDS, INSERT_ONLY, ROW_KIND
from tidewright.plans import ddl
from tidewright.plans.continuous import plan_continuous
from tidewright.plans.gate import AI_NAMES, RESERVED_AI, check_name, check_streaming, gate
from tidewright.plans.lexer import Token, calls, tokens
from tidewright.sources import custom, kafka, sinks
from tidewright.sources.canal import decode_canal
from tidewright.sources.tables import CatalogTable, TableFactory, default_factories
from tidewright.stream import DataStream, StatementSet

MODES = ("auto", "batch", "streaming")
#: Return types of Python annotations.
_TYPES = {int: "bigint", float: "double", str: "string", bool: "boolean", bytes: "binary"}


def pipeline(spark: SparkSession | None = None, config: Mapping[str, str] | None = None, *, name: str | None = None) -> Pipeline:
    return Pipeline(spark or SparkSession.builder.getOrCreate(), config, name=name)


class Readers:
    """Every reader of Spark by its name: ``read_parquet``, ``read_csv``, ``range``, ``from_pandas`` and so on."""

    def __init__(self, owner: Pipeline):
        self._owner = owner

    def __getattr__(self, name: str) -> Callable[..., DataStream]:
        spark = self._owner.spark
        if name.startswith("read_") and hasattr(spark.read, name[5:]):
            made = getattr(spark.read, name[5:])
        elif name == "read_binary_files":
            made = lambda path: spark.read.format("binaryFile").load(path)
        elif name == "range":
            made = lambda *a: spark.range(*a)
        elif name in ("from_pandas", "from_arrow"):
            made = spark.createDataFrame
        elif name in ("from_dataset", "from_dataframe"):
            made = lambda df: df
        elif name == "from_items":
            return self._owner.from_items
        else:
            raise AttributeError(name)
        return lambda *a, **k: self._owner.stream(made(*a, **k))

    def source(self, operation: str | Callable, *args: Any, **kwargs: Any) -> DataStream:
        if callable(operation):
            return self._owner.stream(operation(*args, **kwargs))
        return getattr(self, operation)(*args, **kwargs)


class Pipeline:
    """Owns catalog state and makes streams; one per program is usual."""

    def __init__(self, spark: SparkSession, config: Mapping[str, str] | None = None, *, name: str | None = None):
        self.spark, self.name = spark, name or "pipeline"
        self.config = {"execution.runtime.mode": "auto", **(config or {})}
        if self.config["execution.runtime.mode"] not in MODES:
            raise EngineError(f"unknown mode {self.config['execution.runtime.mode']!r}")
        self.views: dict[str, DataStream] = {}
        self.tables: dict[str, CatalogTable] = {}
        self.factories: dict[str, TableFactory] = default_factories()
        self.scalar_functions: dict[str, tuple[Callable, str]] = {}
        self.ai_functions: dict[str, ai.AiFunction] = {}
        self.download_policy = download.DownloadPolicy()
        self.read = Readers(self)

    # sources

    def stream(self, df: DataFrame, kinds: frozenset[str] | None = None) -> DataStream:
        return DataStream(self, df, kinds or (ALL_KINDS if ROW_KIND in df.columns else INSERT_ONLY))

    def from_dataframe(self, df: DataFrame) -> DataStream:
        return self.stream(df)

    def from_items(self, items: Iterable[Any], schema: str | None = None) -> DataStream:
        """A bounded table; items that aren't mappings become the column ``item``."""
        rows = [dict(i) if isinstance(i, Mapping) else {"item": i} for i in items]
        names = list(dict.fromkeys(k for r in rows for k in r))
        if not rows and schema is None:
            raise EngineError("an empty list needs a schema")
        if schema is not None:
            return self.stream(self.spark.createDataFrame([tuple(r.get(f.strip().split()[0]) for f in _split_fields(schema)) for r in rows], schema))
        import pyarrow as pa

        return self.stream(self.spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n in names} for r in rows])))

    def from_values(self, *values: Mapping) -> DataStream:
        if not values or not all(isinstance(v, Mapping) for v in values):
            raise EngineError("from_values takes one or more mappings")
        return self.from_items(values)

    def read_kafka(self, topics: str | Iterable[str], *, bootstrap_servers: str, **options: Any) -> DataStream:
        return self.stream(kafka.read_kafka(self.spark, topics, bootstrap_servers, **options))

    def read_canal(self, topics: str | Iterable[str], *, bootstrap_servers: str, columns: list[str], ddl_handling: str = "ignore", include_metadata: bool = True, **options: Any) -> DataStream:
        raw = kafka.read_kafka(self.spark, topics, bootstrap_servers, trigger="continuous", **options)
        return self.stream(decode_canal(raw, columns, ddl_handling=ddl_handling, include_metadata=include_metadata), ALL_KINDS)

    def read_rocketmq(self, topic: str, **options: Any) -> DataStream:
        raise EngineError("RocketMQ needs a client library; wrap one in a SourceFunction and use source()")

    def source(self, fn: type[custom.SourceFunction], schema: str, *args: Any, bounded: bool = False, **kwargs: Any) -> DataStream:
        return self.stream(custom.source(self.spark, fn, schema, *args, bounded=bounded, **kwargs))

    # catalog

    def create_temp_view(self, name: str, stream: DataStream) -> None:
        self.views[check_name(name, "view name").lower()] = stream

    def drop_temp_view(self, name: str) -> None:
        if self.views.pop(name.lower(), None) is None:
            raise SQLQueryError(f"there is no view {name}")

    def register_table_factory(self, factory: TableFactory, *, replace: bool = False) -> None:
        if factory.connector in self.factories and not replace:
            raise SQLQueryError(f"the connector {factory.connector} is registered already")
        self.factories[factory.connector] = factory

    # functions

    def register_scalar_function(self, name: str, function: Callable, *, return_type: str | None = None, replace: bool = False) -> None:
        """A Python function for SQL; nulls arrive as None; the return type is given, annotated or a string."""
        key = check_name(name, "function name").lower()
        if inspect.iscoroutinefunction(function):
            raise SQLQueryError("a scalar function can't be a coroutine")
        if key in self.scalar_functions and not replace:
            raise SQLQueryError(f"the function {name} is registered already")
        if key not in self.scalar_functions and (self._built_in(key) or name.upper() in AI_NAMES | RESERVED_AI | media.NAMES | {"DOWNLOAD"}):
            raise SQLQueryError(f"{name} is a built-in function")
        self.scalar_functions[key] = (function, return_type or _annotated(function))

    def drop_scalar_function(self, name: str) -> None:
        if self.scalar_functions.pop(name.lower(), None) is None:
            raise SQLQueryError(f"there is no function {name}")

    def register_ai_function(self, name: str, function: Any, *, fn_constructor_args: tuple = (), fn_constructor_kwargs: Mapping | None = None, batch_size: int = 32, return_type: str | None = None, replace: bool = False) -> None:
        if name.upper() in self.ai_functions and not replace:
            raise SQLQueryError(f"the function {name} is registered already")
        kind = return_type or ("array<double>" if name.upper() == "AI_EMBED" else "string")
        self.ai_functions[name.upper()] = ai.AiFunction(name.upper(), function, fn_constructor_args, fn_constructor_kwargs or {}, batch_size, kind)

    def drop_ai_function(self, name: str) -> None:
        if self.ai_functions.pop(name.upper(), None) is None:
            raise SQLQueryError(f"there is no function {name}")

    def _built_in(self, name: str) -> bool:
        rows = self.spark.sql(f"SHOW SYSTEM FUNCTIONS LIKE '{name}'").limit(1).collect()
        return bool(rows)

    # SQL

    def sql(self, query: str, /, *, tables: Mapping[str, DataStream | DataFrame] | None = None, functions: Mapping[str, Callable] | None = None) -> DataStream:
        """A query over the given tables, the catalog, and, without ``tables``, the streams of the calling frame."""
        bound: dict[str, DataStream] = {}
        if tables is None:
            frame = inspect.currentframe().f_back
            for scope in (frame.f_globals, frame.f_locals):
                bound |= {k.lower(): v for k, v in scope.items() if isinstance(v, DataStream)}
        else:
            bound |= {check_name(k, "table name").lower(): v if isinstance(v, DataStream) else self.stream(v) for k, v in tables.items()}
        return self._query(query, bound, functions or {})

    def _query(self, query: str, bound: Mapping[str, DataStream], functions: Mapping[str, Callable]) -> DataStream:
        gated = gate(query, media.NAMES)
        text = gated.sql
        toks = tokens(text)
        words = {toks[i].text.strip("`").lower() for i in _table_places(toks)}
        sources = {**{k: v for k, v in self.views.items()}, **bound}
        used = {n: s for n, s in sources.items() if n in words}
        for n, t in self.tables.items():
            if n in words and n not in used:
                used[n] = self.stream(self.factories[t.options["connector"]].create_source(self.spark, t))
        mode = self.config["execution.runtime.mode"]
        unbounded = any(s.df.isStreaming for s in used.values())
        if mode == "batch" and unbounded:
            raise SQLQueryError("batch mode can't read an unbounded input")
        if unbounded:
            check_streaming(text)
        text = self._bind_functions(text, gated.functions, functions)
        if unbounded:
            try:
                planned = plan_continuous(text, used, gated.state_ttl)
            except (AnalysisException, ParseException) as e:
                raise SQLQueryError(str(e)) from e
            if planned is not None:
                return DataStream(self, *planned, from_sql=True)
            if gated.state_ttl:
                raise SQLQueryError("STATE_TTL needs a continuous query of one SELECT block with a join or an aggregate")
        token = uuid.uuid4().hex[:10]
        for n, s in used.items():
            s.df.createOrReplaceTempView(f"tw_{token}_{n}")
        try:
            ctes = {m.lower() for m in re.findall(r"(?:\bWITH|,)\s*([A-Za-z_][A-Za-z0-9_]*)\s+AS\s*\(", text, re.IGNORECASE)}
            toks = tokens(text)
            places, out = set(_table_places(toks)), []
            for i, t in enumerate(toks):
                word = t.text.strip("`").lower()
                if i in places and word in used and word not in ctes:
                    following = next((x for x in toks[i + 1 :] if x.kind != "space"), None)
                    alias = following is not None and (following.kind in ("word", "quoted") and not following.is_word(*_AFTER_TABLE))
                    out.append(f"tw_{token}_{word}" + ("" if alias else f" AS {word}"))
                else:
                    out.append(t.text)
            df = self.spark.sql("".join(out))
        except (AnalysisException, ParseException) as e:
            raise SQLQueryError(str(e).replace(f"tw_{token}_", "")) from e
        finally:
            for n in used:
                self.spark.catalog.dropTempView(f"tw_{token}_{n}")
        lower = [c.lower() for c in df.columns]
        twice = {c for c in lower if lower.count(c) > 1}
        if twice:
            if "*" in query:
                df = _renamed(df, twice)
            else:
                raise SQLQueryError(f"the output has the column {sorted(twice)[0]} twice")
        kinds = frozenset().union(*(s.kinds for s in used.values())) if used else INSERT_ONLY
        return DataStream(self, df, kinds if ROW_KIND in df.columns else INSERT_ONLY, from_sql=True)

    def _bind_functions(self, text: str, called: set[str], local: Mapping[str, Callable]) -> str:
        """Registers the functions that a query calls under names of their own, so that a query's own can differ."""
        for name in {n for n in called if n in media.NAMES}:
            media.register(self.spark)
            break
        if "DOWNLOAD" in called:
            download.register(self.spark, self.download_policy)
        for name in called & AI_NAMES:
            if name not in self.ai_functions:
                raise SQLQueryError(f"no backend is registered for {name}")
            ai.register(self.spark, self.ai_functions[name])
        known = {**self.scalar_functions, **{check_name(k, "function name").lower(): (v, _annotated(v)) for k, v in local.items()}}
        for name, (fn, kind) in known.items():
            if name.upper() not in called:
                continue
            own = f"tw_{name}_{id(fn):x}"
            self.spark.udf.register(own, fn, kind)
            arity = _arity(fn)
            toks = tokens(text)
            found = [c for c in calls(toks) if c.name == name.upper()]
            for c in found:
                toks[c.start] = Token("word", own)
            text = "".join(t.text for t in toks)
            for c in found:
                if arity and not arity[0] <= len(c.args) <= arity[1]:
                    raise SQLQueryError(f"{name} takes {arity[0]} to {arity[1]} arguments, not {len(c.args)}")
        return text

    def execute_sql(self, statement: str, /) -> DataStream | Any:
        """DDL, INSERT INTO, or a query over the catalog."""
        parsed = ddl.parse(statement)
        if isinstance(parsed, ddl.CreateTable):
            key = parsed.table.name.lower()
            if key in self.tables and parsed.if_not_exists:
                return None
            if key in self.tables and not parsed.replace:
                raise SQLQueryError(f"the table {parsed.table.name} exists already")
            self._factory(parsed.table).validate(parsed.table)
            self.tables[key] = parsed.table
            return None
        if isinstance(parsed, ddl.DropTable):
            if self.tables.pop(parsed.name.lower(), None) is None and not parsed.if_exists:
                raise SQLQueryError(f"there is no table {parsed.name}")
            return None
        if isinstance(parsed, ddl.InsertInto):
            return self.insert(parsed.name, self._query(parsed.query, {}, {}))
        return self._query(parsed, {}, {})

    def _factory(self, table: CatalogTable) -> TableFactory:
        try:
            return self.factories[table.options["connector"]]
        except KeyError:
            raise SQLQueryError(f"there is no connector {table.options['connector']}") from None

    def insert(self, name: str, rows: DataStream) -> Any:
        """Hands rows to a table's sink, which must take all kinds that the rows may have."""
        if name.lower() not in self.tables:
            raise SQLQueryError(f"there is no table {name}")
        table = self.tables[name.lower()]
        factory = self._factory(table)
        beyond = rows.kinds - factory.supported_sink_row_kinds(table)
        if beyond:
            raise SQLQueryError(f"the sink {name} can't take rows of kind {', '.join(sorted(beyond))}")
        return factory.write(self.spark, table, rows.df)

    def statement_set(self) -> StatementSet:
        return StatementSet(self)

    def explain(self, stream: DataStream) -> str:
        return stream.explain()


_AFTER_TABLE = ("WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "ON", "USING", "GROUP", "ORDER", "LIMIT", "UNION", "HAVING", "INTERSECT", "EXCEPT", "LATERAL", "WINDOW", "NATURAL", "SEMI", "ANTI", "OFFSET", "TABLESAMPLE", "PIVOT")


def _table_places(toks: list[Token]) -> list[int]:
    """Positions of names that stand where a table stands."""
    out, in_from = [], False
    for i, t in enumerate(toks):
        if in_from and t.kind in ("word", "quoted") and not t.is_word("LATERAL"):
            out.append(i)
            in_from = False
        elif t.is_word("FROM", "JOIN") or t.text == "," and _in_from_list(toks, i):
            in_from = True
        elif t.kind not in ("space", "hint") and not t.is_word("LATERAL"):
            in_from = False
    return out


def _in_from_list(toks: list, at: int) -> bool:
    """Whether the comma at ``at`` stands between tables."""
    depth = 0
    for t in reversed(toks[:at]):
        if t.text == ")":
            depth += 1
        elif t.text == "(":
            if depth == 0:
                return False
            depth -= 1
        elif depth == 0 and t.is_word("FROM"):
            return True
        elif depth == 0 and t.is_word("SELECT", "WHERE", "GROUP", "ORDER", "ON", "HAVING", "BY", "WITH"):
            return False
    return False


def _split_fields(schema: str) -> list[str]:
    return re.split(r",(?![^<(]*[>)])", schema)


def _annotated(fn: Callable) -> str:
    kind = getattr(fn, "__annotations__", {}).get("return")
    names = {"int": "bigint", "float": "double", "str": "string", "bool": "boolean", "bytes": "binary"}
    return _TYPES.get(kind) or names.get(kind if isinstance(kind, str) else "", "string")


def _arity(fn: Callable) -> tuple[int, int] | None:
    try:
        params = list(inspect.signature(fn).parameters.values())
    except (TypeError, ValueError):
        return None
    if any(p.kind == p.VAR_POSITIONAL for p in params):
        return None
    return sum(p.default is p.empty for p in params), len(params)


def _renamed(df: DataFrame, twice: set[str]) -> DataFrame:
    """Of equal names, the later ones get their position: ``SELECT *`` over a join stays usable."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        seen[c.lower()] = seen.get(c.lower(), 0) + 1
        names.append(c if seen[c.lower()] == 1 else f"{c}_{seen[c.lower()]}")
    return df.toDF(*names)


__all__ = ["F", "Pipeline", "pipeline"]
