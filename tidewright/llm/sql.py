"""DuckDB SQL for the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from tidewright.llm.quality_rules import BOILERPLATE, SYMBOLS, LineRules
from tidewright.llm.source_mix import HASH_BITS, MOST_COPIES, SHARE, WEIGHTS
from tidewright.llm.topk_search import SCALE

_RULES = LineRules()
_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(regexp_split_to_array({{0}}, '{_SPACE}'), lambda x: x <> '')"


def _symbols(x: str) -> str:
    return f"length(regexp_replace({x}, '[^{SYMBOLS}]+', '', 'g'))"


def _line_fails(x: str) -> str:
    marks = f"({_symbols(x)} + length({x}) - length(replace({x}, '!!', '')))"
    return (
        f"(({marks} >= {_RULES.min_symbols} AND {marks} * {_RULES.symbol_share} > length({x}))"
        f" OR length({x}) - length(replace({x}, '|', '')) >= {_RULES.separators}"
        f" OR (regexp_matches(lower({x}), '{'|'.join(BOILERPLATE)}') AND len({_WORDS.format(x)}) <= {_RULES.boilerplate_words}))"
    )


def quality_rules(docs: str = "documents") -> str:
    """Columns of the query op5; ``rid`` numbers the rows of ``docs``."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT rid, doc_id, t, {_WORDS.format("t")} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, concat_ws(' ', ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4]) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
x AS (
  SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(list_aggregate(ws, 'string_agg', ''))::BIGINT AS word_chars, {_symbols("t")}::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    coalesce(length(list_aggregate(ls, 'string_agg', '')), 0)::BIGINT AS line_chars,
    coalesce(length(list_aggregate(list_filter(ls, lambda x: NOT {_line_fails("x")}), 'string_agg', '')), 0)::BIGINT AS kept_chars
  FROM w LEFT JOIN c ON c.rid = w.rid)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, line_chars, kept_chars,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ((line_chars - kept_chars) * 100 > line_chars * {_RULES.max_lost_percent})) AS kept
FROM x
""".strip()


def source_mix(docs: str = "documents") -> str:
    """Columns of the query op3, by sorting each source's documents by hash."""
    n, d = SHARE
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, source, len({_WORDS.format("coalesce(text, '')")})::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM b GROUP BY source),
w AS (SELECT *, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER q AS pos, (sum(source_size) OVER ())::BIGINT AS total,
    (sum(source_size) OVER (q ROWS UNBOUNDED PRECEDING))::BIGINT - source_size AS before,
    (sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS weight_left
  FROM w WINDOW q AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT *, {n} * total - {d * MOST_COPIES} * before AS left_over FROM o),
p AS (SELECT *, {d * MOST_COPIES} * source_size * weight_left > weight * left_over AS open FROM f),
u AS (SELECT left_over AS u_left, weight_left AS u_weight, pos AS u_at FROM p WHERE open ORDER BY pos LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN u_at IS NULL OR pos < u_at THEN ({MOST_COPIES} * source_size)::DOUBLE
    ELSE (u_left * weight)::DOUBLE / ({d} * u_weight)::DOUBLE END AS target FROM p LEFT JOIN u ON true),
k AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS whole FROM t),
c AS (SELECT b.*, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS budget,
    (sum(size) OVER (PARTITION BY b.source ORDER BY h))::BIGINT AS upto, (sum(size) OVER (PARTITION BY b.source, h))::BIGINT AS here,
    count(*) OVER (PARTITION BY b.source, h) AS n, row_number() OVER (PARTITION BY b.source, h ORDER BY rid) AS place
  FROM b JOIN k ON b.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, source, size, source_size, target, (whole + CASE WHEN size > 0 AND place <= ceil((budget - (upto - here)) * n / here - 0.5) THEN 1 ELSE 0 END)::BIGINT * size AS taken FROM c
""".strip()


def topk_search(rows: str = "embeddings", k: int = 10) -> str:
    """Columns of the query op6, by comparing every query with every row."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM {rows}
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, r.vec_id, coalesce(list_sum(list_transform(list_zip(q.x, r.x), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v r ON r.vec_id <> q.vec_id AND len(q.x) = len(r.x) WHERE q.vec_id % 100 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= {k}
""".strip()


def oracle_sql() -> dict[str, str]:
    return {"op3_source_mix": source_mix(), "op5_quality_rules": quality_rules(), "op6_topk_search": topk_search()}
