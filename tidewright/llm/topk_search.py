"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers.  Rows are packed in blocks; for each dimension a block holds one bitmap per
binary digit (two's complement).  The scores of all rows of a block against a query are themselves a bit-sliced number: the
query's digits pick slices, and carry-save adders on whole bitmaps add those of equal weight.  The top rows are selected
from the most significant slice downward; rows that tie with the last place after the last slice have equal scores, and the
smaller ids among them are taken.

Blocks are built where the rows are, without a shuffle.  Queries are dealt into parts, and the parts are sent to the blocks:
a task's unit is a block with a bounded number of parts, so that memory is bounded and all cores have work; it sends back k
rows per query at most.

Edge cases: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows with a null id;
empty vectors score 0 against each other; each query row has a ranking of its own, also where ids repeat; rows with large components (2^26 or more after quantising) have blocks of their own with as many digits as they need,
and a score of the result that doesn't fit a bigint is an error; only vectors of equal length are compared; equal scores rank by the smaller id; a row that occurs several times with one id is several
candidates, but no row is a candidate for a query with its own id; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import col, cut

#: Rows of a block of the index, and queries of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 8192, 256
#: Parts that meet a block at once at most, and about so many units of work where there are few.
PARTS_AT_ONCE, UNITS = 16, 64
#: Rows of a block whose components don't fit 64 bits.
WIDE_ROWS = 512
SCALE = 1024
_MOST = 1 << 26
_BIGINT = (1 << 63) - 1


def quantised(vector: Iterable[float]) -> np.ndarray:
    """The components as integers, of Python's kind where 64 bits might not hold them."""
    x = np.asarray(vector, np.float64)
    if np.abs(x).max(initial=0) < 2.0**62 / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    # from 2^53 on every double is an integer, and its product with SCALE might not be finite
    return np.array([int(c) * SCALE if abs(c) >= 2.0**53 else math.floor(c * SCALE) for c in x.tolist()], object)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: the vectors that take part, as doubles."""
    v = col(vector_col)
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    ok = v.isNotNull() & F.forall(v, fine) & col(id_col).isNotNull()
    return vectors.where(ok).select(col(id_col).cast("bigint").alias("vec_id"), v.cast("array<double>").alias("x"))


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """(rows, dims) integers -> (dims, bits, words) bitmaps, digit ``b`` of dimension ``d`` in [d, b]."""
    rows, dims = values.shape
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words), np.uint64)
    for b in range(bits):
        digit = ((values >> b) & 1).astype(np.uint8).T
        packed = np.packbits(digit, axis=1, bitorder="little")
        padded = np.zeros((dims, words * 8), np.uint8)
        padded[:, : packed.shape[1]] = packed
        out[:, b] = padded.view(np.uint64)
    return out


def digits_of(values: np.ndarray) -> int:
    """Digits of two's complement that hold all values."""
    lo, hi = int(values.min(initial=0)), int(values.max(initial=0))
    return max((-lo - 1).bit_length() if lo < 0 else 0, hi.bit_length()) + 1


def _column_sum(columns: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Adds bitmaps, given by weight as stacks, with full adders; two's complement of ``width`` digits."""
    words = next(s.shape[1] for c in columns for s in c)
    carry: list[np.ndarray] = []
    out = []
    for w in range(width):
        stacks = (columns[w] if w < len(columns) else []) + carry
        carry = []
        stack = np.concatenate(stacks) if stacks else np.zeros((1, words), np.uint64)
        while len(stack) > 1:
            third = len(stack) // 3
            if third:
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                x = a ^ b
                carry.append((a & b) | (x & c))
                stack = np.concatenate([x ^ c, stack[3 * third :]])
            else:
                carry.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
        out.append(stack[0])
    return out


def score_slices(slices: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """The bit-sliced scores of a block's rows: digits of two's complement, least first.

    A query component q = sum of its digits +-2^j picks the slices of its dimension with weight 2^(j + b); the top slice of
    a dimension counts negatively.  A negative term -2^w s is 2^w (not s) - 2^w; the constants are added at the end.
    """
    dims, bits, words = slices.shape
    width = sum(map(abs, query.tolist())).bit_length() + bits + 1
    columns: list[list[np.ndarray]] = [[] for _ in range(width)]
    constant = 0
    size = np.abs(query)
    for j in range(int(size.max(initial=0)).bit_length()):
        on = (size >> j) & 1 == 1
        for flip in (False, True):
            chosen = np.flatnonzero(on & ((query < 0) == flip))
            if not len(chosen):
                continue
            for b in range(bits):
                negative = flip != (b == bits - 1)
                part = slices[chosen, b]
                columns[j + b].append(~part if negative else part)
                if negative:
                    constant -= len(chosen) << (j + b)
    ones = np.full((1, words), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for w in range(width):
        if constant >> w & 1:
            columns[w].append(ones)
    if not any(columns):
        return [np.zeros(words, np.uint64)]
    return _column_sum(columns, width)


def _count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top_rows(score: list[np.ndarray], live: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows surely in the top k, rows that tie for the places left), from the most significant slice down."""
    sure, tied = np.zeros_like(live), live.copy()
    if _count(live) <= k:
        return _rows(live), np.empty(0, np.int64)
    have = 0
    for place in range(len(score) - 1, -1, -1):
        s = ~score[place] if place == len(score) - 1 else score[place]  # the sign: not negative first
        better = tied & s
        n = have + _count(better)
        if n > k:
            tied = better
        else:
            sure, have, tied = sure | better, n, tied & ~s
            if have == k:
                return _rows(sure), np.empty(0, np.int64)
    return _rows(sure), _rows(tied)


def search_block(ids: np.ndarray, slices: np.ndarray, queries: list[np.ndarray], query_ids: np.ndarray, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(number of the query, query id, row id, score, over) of each query's best rows in a block; ``ids`` ascend.

    ``over`` is 1 or -1 for a score above or below those of 64 bits, which is given as the nearest one that fits.
    """
    live = np.packbits(np.ones(len(ids), np.uint8), bitorder="little")
    full = np.zeros(slices.shape[2] * 8, np.uint8)
    full[: len(live)] = live
    full = full.view(np.uint64)
    for number, (q, query_id) in enumerate(zip(queries, query_ids, strict=True)):
        mine = full
        lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
        if lo < hi:
            mine = full.copy()
            for r in range(lo, hi):
                mine[r >> 6] &= ~np.uint64(1 << (r & 63))
        score = score_slices(slices, q)
        sure, tied = top_rows(score, mine, k)
        rows = np.concatenate([sure, tied[: max(0, k - len(sure))]]).astype(np.int64)
        if not len(rows):
            continue
        value = np.zeros(len(rows), np.int64 if len(score) <= 63 else object)
        for place, s in enumerate(score):
            digit = (s[rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64).astype(value.dtype)
            value += (-digit if place == len(score) - 1 else digit) << place
        values = value.tolist()
        over = [(v > _BIGINT) - (v < -_BIGINT - 1) for v in values]
        yield from zip([number] * len(rows), [int(query_id)] * len(rows), ids[rows].tolist(), [min(max(v, -_BIGINT - 1), _BIGINT) for v in values], over, strict=True)


def _index_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packs the rows of a partition, as they come, in blocks of rows with equal length."""
    # by length and kind: small components, others of 64 bits, and wider ones
    held: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

    def block(key: tuple[int, int]) -> pd.DataFrame:
        dims, rows = key[0], sorted(held.pop(key), key=lambda r: r[0])
        values = np.stack([x for _, x in rows])
        bits = digits_of(values)
        return pd.DataFrame({"dims": [dims], "bits": [bits], "ids": [np.array([i for i, _ in rows], np.int64).tobytes()], "slices": [pack(values, bits).tobytes()]})

    for batch in batches:
        for ident, x in zip(batch["vec_id"], batch["x"], strict=True):
            x = quantised(x)
            key = len(x), 2 if x.dtype == object else int(np.abs(x).max(initial=0) >= _MOST)
            held.setdefault(key, []).append((int(ident), x))
            if len(held[key]) == (WIDE_ROWS if key[1] == 2 else BLOCK_ROWS):
                yield block(key)
    for key in list(held):
        yield block(key)


def _search(k: int):
    def run(blocks: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dims, bits, ids, slices in zip(blocks["dims"], blocks["bits"], blocks["ids"], blocks["slices"], strict=True):
            ids = np.frombuffer(ids, np.int64)
            slices = np.frombuffer(slices, np.uint64).reshape(dims, bits, -(-len(ids) // 64))
            for queries in parts["queries"]:
                query_ids = np.array([q["vec_id"] for q in queries], np.int64)
                found = search_block(ids, slices, [quantised(q["x"]) for q in queries], query_ids, k)
                out += [(queries[n]["query"], *rest) for n, *rest in found]
        return pd.DataFrame(out, columns=["query", "query_id", "vec_id", "score", "over"]).astype("int64")

    return run


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows of ``index`` for each row of ``queries``: ``query_id, rank, vec_id, score``."""
    asked = cut(usable(queries, id_col, vector_col).withColumn("query", F.monotonically_increasing_id()))
    n_parts = max(1, -(-asked.count() // QUERY_ROWS))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query"), F.lit(n_parts)).cast("int"))
    blocks = usable(index, id_col, vector_col).mapInPandas(_index_blocks, "dims int, bits int, ids binary, slices binary")
    blocks = cut(blocks.withColumn("block", F.monotonically_increasing_id()))
    n_blocks = max(1, blocks.count())
    at_once = min(PARTS_AT_ONCE, max(1, n_blocks * n_parts // UNITS))
    groups = -(-n_parts // at_once)
    tasks = min(n_blocks * groups, max(UNITS, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # the blocks and, as often as there are blocks of their length, the parts meet by block and group of parts
    parts = asked.groupBy("part", F.size("x").alias("dims")).agg(F.collect_list(F.struct("query", "vec_id", "x")).alias("queries"))
    sent = parts.join(blocks.select("block", "dims"), "dims").select(F.col("block").alias("to_block"), F.floor(F.col("part") / at_once).cast("int").alias("to_group"), "queries")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    left, right = (df.repartition(tasks, *keys).groupBy(*keys) for df, *keys in ((blocks, "block", "group"), (sent, "to_block", "to_group")))
    found = left.cogroup(right).applyInPandas(_search(k), "query bigint, query_id bigint, vec_id bigint, score bigint, over bigint")
    order = Window.partitionBy("query").orderBy(F.col("over").desc(), F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = F.when(F.col("over") == 0, F.col("score")).otherwise(F.raise_error(F.lit("op6: a score does not fit a bigint")).cast("bigint"))
    return best.select("query_id", "rank", "vec_id", score.alias("score"))
