"""Near-duplicate self-join of texts: word n-gram Jaccard similarity, found by MinHash banding, verified on full sets.

1. Each text becomes the set of its n-gram hashes (64 bits); texts with equal sets are one *node*, so copies are counted
   and never paired.
2. The MinHash signature of a node is cut into bands; nodes are shuffled on the band hashes, and each is linked to the
   smallest node of its bucket only.  Connected nodes are a candidate group.
3. The full sets of candidate groups (no other text moves) meet once per group.  A large group is dealt out by hash into
   chunks, and each pair of chunks is a task of its own with bounded memory.  A task compares all its nodes by sparse
   products, sends back the number of links of each node and a spanning forest of the links, but no pairs.
4. The forests' connected components are the classes.

n-gram hashes of 64 bits stand for n-grams, and 64-bit hashes of sets for sets: with 10^9 different texts, 0.03 of them would be
expected to share a hash by chance.

Edge cases: a text with fewer than n words, but at least one, has one n-gram, all its words; a null text and a text
without words have no n-gram and are each linked to nothing; a null id is allowed and sorts first; repeated rows are
copies; an empty table gives an empty result; other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded, col, cut, fresh, map_texts

#: Words of an n-gram, and the similarity from which two texts are linked.
N, SIMILARITY = 5, 0.8
#: The recall that bands and rows are chosen for, and the hashes that may be spent on it.
RECALL, MAX_HASHES = 0.9998, 256
#: About so many nodes, and n-grams, go in one chunk of a candidate group.
CHUNK_NODES, CHUNK_GRAMS = 128, 1 << 17
#: Columns of a dense slab in a comparison.
_SLAB = 4096
_SEED = 20_240_607


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding that finds pairs at ``similarity`` with ``recall`` within ``most`` hashes."""
    best = (1, 1)
    for rows in range(1, 33):
        p = similarity**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)], dtype=np.uint64) for b in (base, inverse))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, by one pass of a running polynomial over the text's bytes."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = ~_IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, word, False]))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers(1 << int(max(len(raw), 4096)).bit_length())
    run = np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)
    total = run[end - 1] - np.where(start > 0, run[start - 1], np.uint64(0))
    return _mix(total * down[start] + (end - start).astype(np.uint64))


def gram_set(text: str, n: int = N) -> np.ndarray:
    """The sorted different n-gram hashes of a text."""
    with np.errstate(over="ignore"):
        words = word_hashes(text)
        if not len(words):
            return words
        n = min(n, len(words))
        size = len(words) - n + 1
        total = np.full(size, n, np.uint64)
        for k in range(n):
            total = _mix(total * np.uint64(0x2545F4914F6CDD1D) + words[k : k + size])
    return np.unique(total)


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    return rng.integers(0, 1 << 32, count, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, count, np.uint32)


def signature(grams: np.ndarray, count: int) -> np.ndarray:
    """The MinHash signature of a set."""
    a, b = _permutations(count)
    h = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        part = h[at : at + 512]
        np.minimum(out, (a[:, None] * part[None, :] + b[:, None]).min(axis=1), out=out)
    return out


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit hash of each band of the signature."""
    sig = signature(grams, bands * rows).astype(np.uint64).reshape(bands, rows)
    with np.errstate(over="ignore"):
        out = _mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(rows):
            out = _mix(out * np.uint64(0x2545F4914F6CDD1D) + sig[:, k])
    return out.view(np.int64)


def _set_key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes(), _SEED)).view(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (longs, each edge in any direction) -> ``node, root`` for every node of an edge; root is one of its component.

    Each round sends every node to its smallest neighbour, follows that pointer once more, and goes on with the contracted
    edges, until none is left.  Ids should be hashes, as those of nodes here are: pointers to the smallest of random
    neighbours are short chains, so that even in a path a fixed share of the nodes goes in each round.  Nothing is gathered
    on the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")))
        again = step.select(F.col("node").alias("via"), F.col("to").alias("end"))
        step = cut(step.join(again, F.col("to") == F.col("via")).select("node", F.col("end").alias("to")))
        if labels is None:
            labels = step.select("node", F.col("to").alias("root"))
        else:
            labels = labels.join(step.select(F.col("node").alias("via"), "to"), F.col("root") == F.col("via"), "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = cut(labels)
        for side in ("a", "b"):
            edges = edges.join(step.select(F.col("node").alias("via"), "to"), F.col(side) == F.col("via")).withColumn(side, F.col("to")).drop("via", "to")
        edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _linked(sets: list[np.ndarray], split: int | None, similarity: float) -> np.ndarray:
    """Which sets are similar enough, as a square matrix; with ``split``, only pairs across that position count."""
    sizes = np.array([len(s) for s in sets], np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(column, minlength=len(values)) > 1
    place = np.cumsum(shared) - 1
    inside = shared[column]
    row, column = row[inside], place[column[inside]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(shared.sum()), _SLAB):
        lo, hi = np.searchsorted(column, [at, at + _SLAB])
        slab = np.zeros((len(sets), _SLAB), np.float32)
        slab[row[lo:hi], column[lo:hi] - at] = 1
        common += slab @ slab.T
    both = sizes[:, None] + sizes[None, :] - common
    links = common >= similarity * both - 1e-9
    np.fill_diagonal(links, False)
    if split is not None:
        links[:split, :split] = False
        links[split:, split:] = False
    return links


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(len(links)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for i, j in zip(*np.nonzero(np.triu(links)), strict=True):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[a] = b
            edges.append((int(i), int(j)))
    return edges


def _compare(similarity: float):
    """For rows sorted by (root, ci, cj): per node and group its weighted number of links, and forest edges."""

    def finish(rows: list[tuple]) -> Iterator[tuple]:
        seen: dict[tuple, tuple] = {}
        for r in rows:
            seen.setdefault(r[3], r)
        rows = sorted(seen.values(), key=lambda r: r[4])  # chunk ci before cj
        if len(rows) < 2:
            return
        two = rows[0][1] != rows[0][2]
        split = sum(r[4] == r[1] for r in rows) if two else None
        links = _linked([np.frombuffer(r[6], np.uint64) for r in rows], split, similarity)
        weight = links @ np.array([r[5] for r in rows], np.int64)
        for r, w in zip(rows, weight, strict=True):
            if w:
                yield r[3], r[3], int(w)
        for i, j in _forest(links):
            yield rows[i][3], rows[j][3], 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, out = None, [], []
        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                if r[:3] != key:
                    out += finish(rows)
                    key, rows = r[:3], []
                rows.append(r)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["a", "b", "w"])
                out = []
        out += finish(rows)
        yield pd.DataFrame(out, columns=["a", "b", "w"]).astype("int64")

    return run


def _nodes(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, th, text`` -> ``doc_id, th, k, n, bands`` for each row; k is null for a text without words."""

    def run(texts: list[str | None]) -> tuple[list, ...]:
        k, size, hashes = [], [], []
        for text in texts:
            grams = gram_set(text, n) if text else ()
            k.append(_set_key(grams) if len(grams) else None)
            size.append(len(grams))
            hashes.append(band_hashes(grams, bands, rows) if len(grams) else None)
        return k, size, hashes

    return map_texts(docs, "text", lambda: run, "k bigint, n bigint, bands array<bigint>", ["doc_id", "th"])


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per input row: ``doc_id, th`` (hash of its text), ``class_id`` (smallest id of its class), ``class_th``, ``n_links``, ``words`` (0 if it has none).

    ``n_links`` counts the other rows at ``similarity`` or more, copies included.
    """
    slim = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text"))
    bands, rows = choose_bands(similarity, recall)
    every = cut(_nodes(slim, n, bands, rows))
    nodes = every.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = cut(nodes)
    # the smallest of a bucket is found by partial aggregates, and joined back: a hot bucket's rows need not meet in one task
    buckets = nodes.select("k", F.explode("bands").alias("bucket"))
    least = cut(buckets.groupBy("bucket").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo <> hi").select("bucket", "lo"))
    groups = components(buckets.join(bounded(least), "bucket").where("k <> lo").select(F.col("k").alias("a"), F.col("lo").alias("b")))

    members = cut(groups.join(nodes.drop("bands"), F.col("node") == F.col("k")).select("root", "k", "copies", "n", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th")))
    # only groups of several chunks are looked up, as all others are one
    sums = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / CHUNK_NODES), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("int").alias("chunks"))
    large = bounded(cut(sums.where("chunks > 1")))
    dealt = members.join(large, "root", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("k"), F.col("chunks")).cast("int"))
    dealt = bounded(cut(dealt))
    found = slim.join(dealt, slim["doc_id"].eqNullSafe(dealt["rep_id"]) & (slim["th"] == dealt["rep_th"])).select("root", "k", "chunk", "chunks", "copies", "text")
    with_sets = map_texts(found, "text", lambda: lambda texts: [[gram_set(t, n).tobytes() for t in texts]], "grams binary", ["root", "k", "chunk", "chunks", "copies"])
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    blocks = with_sets.withColumn("other", other).select("root", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "k", "chunk", "copies", "grams")
    blocks = blocks.repartition("root", "ci", "cj").sortWithinPartitions("root", "ci", "cj")
    outcome = cut(blocks.mapInPandas(_compare(similarity), "a bigint, b bigint, w bigint"))

    links = outcome.where("w > 0").groupBy(F.col("a").alias("k")).agg(F.sum("w").alias("w"))
    roots = components(outcome.where("w = 0").select("a", "b")).select(F.col("node").alias("k"), "root")
    # the smallest row of each class of several nodes, written before it is joined back, so that a large class can be split
    linked = cut(roots.join(nodes.select("k", "rep"), "k").select("k", "root", "rep"))
    named = bounded(cut(linked.groupBy("root").agg(F.min("rep").alias("first"))))
    firsts = linked.join(named, "root").select("k", "first")
    info = nodes.select("k", "copies", "rep").join(firsts, "k", "left").join(links, "k", "left")
    info = info.where("copies > 1 OR first IS NOT NULL OR w IS NOT NULL").select("k", F.coalesce("first", "rep").alias("first"), (F.col("copies") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"))
    # written before the join, so that the rows of a text with very many copies can be split
    info = bounded(cut(info))
    out = every.select("doc_id", "th", "k", "n").join(info, "k", "left")
    alone = F.col("first").isNull()
    return out.select("doc_id", "th", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.when(alone, F.col("th")).otherwise(F.col("first.th")).alias("class_th"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.col("n").alias("words"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest id stays; texts without words stay.

    If that id and text occur in several rows, one of these rows stays.
    """
    found = cut(classes(docs, id_col, text_col, n, similarity, recall))
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))
    ident, th, other_id, other_th = (fresh(docs, f"_join_{x}") for x in ("id", "th", "other_id", "other_th"))
    named = lambda df: df.select(F.col("doc_id").alias(other_id), F.col("th").alias(other_th))
    same = F.col(ident).eqNullSafe(F.col(other_id)) & (F.col(th) == F.col(other_th))
    rows = docs.withColumns({ident: col(id_col), th: F.xxhash64(col(text_col))})
    out = rows.join(bounded(cut(named(found.where(~first)).distinct())), same, "left_anti")
    repeated = cut(named(found.where(first & (F.col("words") > 0)).groupBy("doc_id", "th").agg(F.count("*").alias("c")).where("c > 1")))
    if not repeated.isEmpty():
        twice = out.join(bounded(repeated), same, "left_semi").dropDuplicates([ident, th])
        out = out.join(bounded(repeated), same, "left_anti").unionByName(twice)
    return out.select(*(col(c) for c in docs.columns))
