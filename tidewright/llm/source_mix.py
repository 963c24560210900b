"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash of its id and text.  Words are summed by source and hash bucket, the bucket in which a source's
budget runs out is found, and only that bucket is divided further, 12 bits at a time, until it holds one hash value.
The outcome is one threshold per source; a document is taken if its hash lies below.  Thresholds are nested: a larger
budget takes a superset.  Documents are never sorted, and a hot source costs no more than any other, as every task
sends at most one partial sum for each source and bucket.  Rows whose hash is the threshold itself, one document or
repeats of it, are counted off partition by partition.

Edge cases: a null text has size 0 and hashes as an empty one; a null source is a source of its own, last in order; a null
id hashes as the text ``null``; repeated rows (same id and text) share a hash, and where the budget ends among them as many of
them are taken as it allows; a source without words has target 0 and nothing of it is taken; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import col, cut, fresh, words_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix holds SHARE[0] / SHARE[1] of all words.
SHARE = (3, 2)
#: No document is taken more often than this.
MOST_COPIES = 2
#: Bits of a hash and of one refinement.
HASH_BITS, LEVEL_BITS = 60, 12
#: A table of sources with up to so many bytes is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 1 << 20


def hash_of(ident: Column, text: Column) -> Column:
    key = F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def size_of(text: Column) -> Column:
    return F.size(words_of(text)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``source, source_size`` -> also ``target``: weighted shares, capped at MOST_COPIES times the size, excess reshared.

    Sources sorted by cap / weight reach their caps in that order, so running sums give the outcome of all rounds of
    resharing at once.  The input has a row for each source, already aggregated.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(w).cast("bigint") for w in weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight)
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    df = df.withColumns({"total": F.sum("source_size").over(every), "at": F.row_number().over(order), "size_so_far": F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "weight_left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    # budget left for this source and the later ones, in units of 1 / SHARE[1]
    left = SHARE[0] * F.col("total") - SHARE[1] * MOST_COPIES * (F.col("size_so_far") - F.col("source_size"))
    df = df.withColumn("left", left)
    df = df.withColumn("open", SHARE[1] * MOST_COPIES * F.col("source_size") * F.col("weight_left") > F.col("weight") * F.col("left"))
    first = F.min(F.when(F.col("open"), F.struct("at", "left", "weight_left"))).over(every)
    df = df.withColumn("first", first)
    level = (F.col("first")["left"] * F.col("weight")).cast("double") / (SHARE[1] * F.col("first")["weight_left"]).cast("double")
    capped = F.col("first").isNull() | (F.col("at") < F.col("first")["at"])
    return df.select("source", "source_size", F.when(capped, (F.col("source_size") * MOST_COPIES).cast("double")).otherwise(level).alias("target"))


def _with_state(left: DataFrame, state: DataFrame, small: bool, source: str = "source") -> DataFrame:
    s = state.withColumnRenamed("source", fresh(left, "_mix_source"))
    return left.join(F.broadcast(s) if small else s, left[source].eqNullSafe(s[s.columns[state.columns.index("source")]]), "inner")


def thresholds(base: DataFrame, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, bool]:
    """``source, size, h`` of every document -> one row per source: ``source_size, target, whole, cut_at, cut_rows``.

    A document is taken ``whole`` times, and once more if ``h < cut_at``; so are ``cut_rows`` of those with ``h = cut_at``.
    Also returns whether the table is proven small enough to broadcast.
    """
    sizes = cut(base.groupBy("source").agg(F.sum("size").alias("source_size")))
    row = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0)).alias("b")).first()
    small = row["n"] * 64 + row["b"] <= BROADCAST_BYTES
    aims = targets(sizes, weights)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    aims = cut(aims.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")))
    state = aims.select("source", F.lit(0).cast("bigint").alias("prefix"), F.col("budget").alias("left"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = _with_state(base, state, small).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("left").alias("left"))
        run = sums.withColumn("end", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
        edge = run.where(F.col("end") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "end", "words", "rows", "left")).alias("e"))
        state = edge.select("source", F.col("e.bucket").alias("prefix"), (F.col("e.left") - (F.col("e.end") - F.col("e.words"))).alias("left"), F.col("e.words").alias("words"), F.col("e.rows").alias("rows"))
    cuts = state.select(F.col("source").alias("edge_source"), F.col("prefix").alias("cut_at"), F.ceil(F.col("left") * F.col("rows") / F.col("words") - 0.5).alias("cut_rows"))
    out = aims.join(F.broadcast(cuts) if small else cuts, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source", "budget")
    return cut(out), small


def _with_copies(rows: DataFrame, source: str, h: str, part: str, whole: str, cut_at: str, cut_rows: str, copies: str) -> DataFrame:
    """Adds ``copies``; ``rows`` with the threshold's hash must keep their ``part`` from one reading to the next.

    Only rows with the threshold's hash are counted off: within each part, and the parts one after the other.
    """
    at_edge = F.coalesce(col(h) == col(cut_at), F.lit(False))
    plain = rows.where(~at_edge).withColumn(copies, col(whole) + F.when(F.coalesce(col(h) < col(cut_at), F.lit(False)), 1).otherwise(0))
    edge = rows.where(at_edge)
    place, before, key, other = (fresh(rows, f"_mix_{n}") for n in ("place", "before", "key", "part2"))
    counts = edge.groupBy(col(source).alias(key), col(part).alias(other)).agg(F.count("*").alias(place))
    earlier = Window.partitionBy(key).orderBy(other).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(key, other, F.coalesce(F.sum(place).over(earlier), F.lit(0)).alias(before))
    edge = edge.withColumn(place, F.row_number().over(Window.partitionBy(col(source), col(part)).orderBy(col(h))))
    edge = edge.join(counts, col(source).eqNullSafe(F.col(key)) & (col(part) == F.col(other)))
    edge = edge.withColumn(copies, col(whole) + F.when(F.col(place) + F.col(before) <= col(cut_rows), 1).otherwise(0))
    return plain.unionByName(edge.drop(place, before, key, other))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Per document: ``doc_id, source, size, source_size, target, copies, taken`` (copies times size)."""
    slim = docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), size_of(col(text_col)).alias("size"), hash_of(col(id_col), col(text_col)).alias("h"))
    base = cut(slim.withColumn("part", F.spark_partition_id()))
    state, small = thresholds(base, weights)
    out = _with_copies(_with_state(base, state, small), "source", "h", "part", "whole", "cut_at", "cut_rows", "copies")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` in the mix, each as often as it is taken, with the columns of ``docs``."""
    base = cut(docs.select(col(source_col).alias("source"), size_of(col(text_col)).alias("size"), hash_of(col(id_col), col(text_col)).alias("h")))
    state, small = thresholds(base, weights)
    names = {c: fresh(docs, f"_mix_{c}") for c in ("whole", "cut_at", "cut_rows", "own", "h", "part", "copies")}
    side = state.select(F.col("source").alias(names["own"]), *(F.col(c).alias(names[c]) for c in ("whole", "cut_at", "cut_rows")))
    rows = docs.withColumns({names["h"]: hash_of(col(id_col), col(text_col))})
    rows = rows.join(F.broadcast(side) if small else side, col(source_col).eqNullSafe(F.col(names["own"])), "inner")
    at_edge = F.coalesce(F.col(names["h"]) == F.col(names["cut_at"]), F.lit(False))
    # the rows at the threshold are written, so that their partitions are what they are
    edge = cut(rows.where(at_edge).withColumn(names["part"], F.spark_partition_id()))
    rows = rows.where(~at_edge).withColumn(names["part"], F.lit(0)).unionByName(edge)
    args = (names[c] for c in ("h", "part", "whole", "cut_at", "cut_rows", "copies"))
    taken = _with_copies(rows, source_col, *args).where(F.col(names["copies"]) > 0)
    n = names["copies"]
    return taken.withColumn(n, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n)))).select(*(col(c) for c in docs.columns))
