"""Line-first quality rules: judge every line, remove failures, then reject documents that lose too much text.

Only DataFrame functions are used; nothing is shuffled, so a run is one narrow pass whose memory is bounded by
the longest single text.

Edge cases: a null text counts as empty (no words, hence ``base_failed``); repeated rows and equal doc_ids are judged row
by row; an empty table gives an empty result; input columns other than the id and the text are ignored by
``line_quality`` and passed through by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import col, fresh, words_of

#: Characters that mark junk when dense.
SYMBOLS = "#*$%&|<>"

#: Phrases of page furniture; a line holding one is boilerplate if it has at most ``boilerplate_words`` words.
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use of cookies",
    "enable javascript",
    "click here",
    "read more",
    "sign up for our newsletter",
    "lorem ipsum",
)

#: Words in a window of the repetition count.
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the final decision.

    symbol_share: a line fails if over 1/symbol_share of its characters are symbols or doubled exclamation marks
    (and there are at least ``min_symbols``).  separators: so many ``|`` make a line navigation.  boilerplate_words: the
    longest line, in words, that a boilerplate phrase condemns.  max_lost_percent: a document that loses more of its
    line characters is rejected.
    """

    symbol_share: int = 12
    min_symbols: int = 3
    separators: int = 2
    boilerplate_words: int = 20
    max_lost_percent: int = 50


def _count_of(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", ""))


def line_fails(line: Column, rules: LineRules) -> Column:
    """True for a line that a punctuation, navigation or boilerplate rule removes."""
    marks = symbol_count(line) + _count_of(line, "!!")
    punctuation = (marks >= rules.min_symbols) & (marks * rules.symbol_share > F.length(line))
    navigation = _count_of(line, "|") >= rules.separators
    boilerplate = F.lower(line).rlike("|".join(BOILERPLATE)) & (F.size(words_of(line)) <= rules.boilerplate_words)
    return punctuation | navigation | boilerplate


def _repeat_words(base: DataFrame, words: str, out: str) -> DataFrame:
    """Adds ``out``: words that lie in a WINDOW-word window found twice or more in the row.

    Hashes of all windows find the rows that can have repeats at all; only there are windows sorted, and their texts
    decide, so that a hash collision can't add a word.
    """
    w = F.col(words)
    hashes, pairs, near, texts, at = (fresh(base, f"{out}_{k}") for k in ("h", "p", "n", "t", "a"))
    window = lambda i: [F.get(w, i + k) for k in range(WINDOW)]
    empty = lambda kind: F.array().cast(kind)
    df = base.withColumn(hashes, F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*window(i)))).otherwise(empty("array<bigint>")))
    h = F.col(hashes)
    df = df.withColumn(pairs, F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("k"), i.alias("i"))))).otherwise(empty("array<struct<k:bigint,i:int>>")))

    def repeated(name: str) -> Column:
        a = F.col(name)
        twin = lambda x, i: F.coalesce(F.get(a, i - 1)["k"] == x["k"], F.lit(False)) | F.coalesce(F.get(a, i + 1)["k"] == x["k"], F.lit(False))
        return F.filter(a, twin)

    df = df.withColumn(near, repeated(pairs))
    df = df.withColumn(texts, F.array_sort(F.transform(F.col(near), lambda x: F.struct(F.concat_ws(" ", *window(x["i"])).alias("k"), x["i"].alias("i")))))
    df = df.withColumn(at, F.sort_array(F.transform(repeated(texts), lambda x: x["i"])))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).cast("bigint").alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW).cast("bigint"), p.cast("bigint") - a["last"])).alias("n"), p.cast("bigint").alias("last"))
    return df.withColumn(out, F.aggregate(F.col(at), start, step, lambda a: a["n"])).drop(hashes, pairs, near, texts, at)


def judge(df: DataFrame, text: str, rules: LineRules = LineRules()) -> tuple[DataFrame, dict[str, str]]:
    """Adds the counts, the cleaned text and the verdicts; also returns the names these columns got (input columns stay)."""
    names = {}
    for k in ("raw", "words", "lines", "good", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars", "cleaned", "base_failed", "kept"):
        names[k] = fresh(df, f"_q_{k}")
    n = {k: F.col(v) for k, v in names.items()}
    out = df.withColumn(names["raw"], F.coalesce(col(text), F.lit("")))
    out = out.withColumn(names["words"], words_of(n["raw"])).withColumn(names["lines"], F.filter(F.split(n["raw"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn(names["good"], F.filter(n["lines"], lambda x: ~line_fails(x, rules)))
    out = out.withColumns(
        {
            names["n_words"]: F.size(n["words"]).cast("bigint"),
            names["word_chars"]: F.length(F.array_join(n["words"], "")).cast("bigint"),
            names["n_symbols"]: symbol_count(n["raw"]).cast("bigint"),
            names["n_dup_lines"]: (F.size(n["lines"]) - F.size(F.array_distinct(n["lines"]))).cast("bigint"),
            names["line_chars"]: F.length(F.array_join(n["lines"], "")).cast("bigint"),
            names["kept_chars"]: F.length(F.array_join(n["good"], "")).cast("bigint"),
            names["cleaned"]: F.array_join(n["good"], "\n"),
        }
    )
    out = _repeat_words(out, names["words"], names["n_repeat_words"])
    lost = (n["line_chars"] - n["kept_chars"]) * 100 > n["line_chars"] * rules.max_lost_percent
    out = out.withColumn(names["base_failed"], (n["n_words"] < 10) | (n["n_repeat_words"] * 100 > n["n_words"] * 20))
    out = out.withColumn(names["kept"], ~n["base_failed"] & ~lost)
    return out, names


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: the id, the counts, the cleaned text and the verdicts (``base_failed``, ``kept``)."""
    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    out, n = judge(slim, "text", rules)
    keep = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars", "base_failed", "kept", "cleaned")
    # a generator keeps filters on these columns from being rewritten in terms of the text, once per use
    return out.select(F.inline(F.array(F.struct("doc_id", *(F.col(n[k]).alias(k) for k in keep)))))


def keep_clean(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs`` as they are: failing lines stay in the text."""
    out, n = judge(docs, text_col, rules)
    # as a filter, the optimizer would write the whole computation into the condition, once per use; a generator stays apart
    once = F.explode(F.when(F.col(n["kept"]), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))).alias(fresh(out, "_q_once"))
    return out.select(*(col(c) for c in docs.columns), once).select(*(col(c) for c in docs.columns))
