"""AI functions: a registered backend is called on batches of argument tuples."""

from __future__ import annotations

import asyncio
import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewright.errors import SQLQueryError
from tidewright.plans.gate import AI_NAMES, RESERVED_AI


@dataclass
class AiFunction:
    """``function`` gets a list of argument tuples and returns as many results, in order; a class is built once per task."""

    name: str
    function: Any
    args: tuple = ()
    kwargs: Mapping = field(default_factory=dict)
    batch_size: int = 32
    return_type: str = "string"

    def __post_init__(self) -> None:
        if self.name.upper() in RESERVED_AI or self.name.upper() not in AI_NAMES:
            raise SQLQueryError(f"{self.name} is no AI function that can be registered")
        if self.batch_size < 1:
            raise SQLQueryError("batch_size must be positive")


def call_backend(backend: Callable, rows: list[tuple], batch_size: int) -> list[Any]:
    """Results for rows, None where an argument is null; equal rows are asked once."""
    asked = list(dict.fromkeys(r for r in rows if all(v is not None for v in r)))
    got: dict[tuple, Any] = {}
    for at in range(0, len(asked), batch_size):
        part = asked[at : at + batch_size]
        out = backend(part)
        out = asyncio.run(out) if inspect.isawaitable(out) else out
        out = list(out)
        if len(out) != len(part):
            raise SQLQueryError("an AI function must return one result for each row")
        got |= dict(zip(part, out, strict=True))
    return [got.get(r) for r in rows]


def register(spark: SparkSession, ai: AiFunction, name: str | None = None) -> None:
    """Makes the function callable in SQL with one or two arguments, on Arrow batches."""
    built: list[Callable] = []

    def run(*columns: pd.Series) -> pd.Series:
        if not built:
            built.append(ai.function(*ai.args, **ai.kwargs) if inspect.isclass(ai.function) else ai.function)
        rows = [tuple(None if v is None or isinstance(v, float) and v != v else v for v in r) for r in zip(*columns, strict=True)]
        return pd.Series(call_backend(built[0], rows, ai.batch_size), dtype="object")

    spark.udf.register(name or ai.name.lower(), F.pandas_udf(run, ai.return_type, F.PandasUDFType.SCALAR).asNondeterministic())
