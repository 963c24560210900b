"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: White space in the sense of the contracts: blank, \t, \n, \v, \f, \r.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    name, n = base, 0
    while name.lower() in taken:
        n += 1
        name = f"{base}_{n}"
    return name


def col(name: str) -> Column:
    """A column by its literal name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is empty and one machine does all."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        have = spark.sparkContext.getCheckpointDir()
        if not have and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        path = have.rsplit("/", 1)[0] if have else "file://" + os.path.join(tempfile.gettempdir(), "tidewright-checkpoints")
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back, so that later passes don't compute it again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Rows of a few numbers each up to which a table is broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcasting if a count proves it small; otherwise Spark joins it by shuffling.

    For tables that are already written (see ``cut``) and whose rows are a few numbers wide.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


#: Bytes of text that a Python worker turns into objects at once; a longer text is taken alone.
SLICE_BYTES = 2 << 20


def text_slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose last column holds about ``most`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype("int64")
    start = 0
    while start < batch.num_rows:
        end = start + max(1, int(sizes[start:].cumsum().searchsorted(most)))
        yield batch.slice(start, end - start)
        start = end


def map_texts(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[str | None]], Sequence[Iterable]]], added: str, keep: Sequence[str]) -> DataFrame:
    """``df``'s columns ``keep``, as they are, and the columns ``added`` that Python makes of the texts, batch by batch.

    ``make`` is called once for each task and returns the function from the texts of a batch to the values of each new
    column.  Kept columns never leave Arrow, so that nulls and large integers stay what they are.
    """
    new = StructType.fromDDL(added)
    kinds = [to_arrow_type(f.dataType) for f in new]
    # plain names in between: Spark doesn't take dots in names there
    slim = df.select(*(col(c).alias(f"_c{i}") for i, c in enumerate(keep)), col(text_col).alias("_text"))
    schema = StructType([*slim.schema.fields[:-1], *(StructField(f"_n{i}", f.dataType) for i, f in enumerate(new))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = make()
        for whole in batches:
            for batch in text_slices(whole):
                columns = made(batch.column(batch.num_columns - 1).to_pylist())
                fresh_ones = [x if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *fresh_ones], names=names)

    return slim.mapInArrow(run, schema).toDF(*keep, *new.names)
