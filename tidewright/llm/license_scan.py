"""Finding license notices: exact phrases, and short notices with a bounded number of edits.

A text is brought to its words: A-Z in lower case, words joined by one blank.  A notice of which at most e characters may
be inserted, deleted or replaced is cut in e + 1 pieces; by the pigeonhole principle an occurrence holds one piece
unchanged.  An automaton over the pieces of all notices finds such seeds in one pass, and around each seed, in a window as
long as the notice and its edits, the regex library's bounded-error matching verifies the notice and reports its span and
edits.  Words that tell a licence from others must stand unchanged.  Of overlapping places of one notice the one with
the fewest edits counts, then the first.

Edge cases: a null text counts as empty; a text without words has no notice, null first and last words and score 0; long
texts are searched whole; rows are handled one by one, so repeated rows, empty tables and further columns need no care.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import regex
from pyspark.sql import DataFrame

from tidewright.llm.common import col, map_texts

# The phrases of the contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Short notices in words as ``words_of`` gives them, their labels, and the words of each that no edit may touch.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("released under the mit license", "mit", "mit"),
    ("licensed under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", ""),
    ("licensed under the gnu general public license version", "gpl", "gnu general"),
    ("gnu general public license as published by the free software foundation", "gpl", "gnu general"),
    ("gnu lesser general public license", "lgpl", "gnu lesser"),
    ("gnu affero general public license", "agpl", "gnu affero"),
    ("redistribution and use in source and binary forms with or without modification", "bsd", ""),
    ("licensed under the bsd 3 clause license", "bsd", "bsd"),
    ("mozilla public license version 2 0", "mpl", "mozilla"),
    ("eclipse public license version 2 0", "epl", "eclipse"),
    ("licensed under cc by nc 4 0", "cc-by-nc", "cc by nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa", "cc by sa"),
    ("creative commons attribution noncommercial 4 0 international", "cc-by-nc", "noncommercial"),
    ("creative commons attribution sharealike 4 0 international", "cc-by-sa", "sharealike"),
    ("this is free and unencumbered software released into the public domain", "unlicense", ""),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", ""),
)

#: One edit is allowed for each so many characters of a notice.
CHARS_PER_EDIT = 14

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Hit:
    """A place of a notice or phrase; positions in the joined words, ``edits`` 0 for a phrase."""

    label: str
    start: int
    end: int
    edits: int
    length: int


class NoticeSearch:
    """Seeds and verifying patterns of a list of notices."""

    def __init__(self, notices: tuple[tuple[str, str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for at, (text, label, fixed) in enumerate(notices):
            edits = max(1, len(text) // chars_per_edit)
            pattern = regex.compile(f"(?b)(?:{regex.escape(text, special_only=True, literal_spaces=True)}){{e<={edits}}}")
            self.notices.append((text, label, edits, pattern, f" {fixed} " if fixed else ""))
            cuts = [len(text) * k // (edits + 1) for k in range(edits + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[lo:hi], []).append((at, lo))
        self.automaton = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), tuple(uses)))
        self.automaton.make_automaton()

    def hits(self, joined: str) -> list[Hit]:
        """Notices within their edits, those of one notice apart from each other."""
        windows: dict[int, set[int]] = {}
        for end, (n, uses) in self.automaton.iter(joined):
            for at, offset in uses:
                windows.setdefault(at, set()).add(end + 1 - n - offset)
        out: list[Hit] = []
        for at, starts in windows.items():
            text, label, edits, pattern, fixed = self.notices[at]
            found = set()
            for start in starts:
                m = pattern.search(joined, max(0, start - edits), start + len(text) + edits)
                if m and (not fixed or fixed in _whole_words(joined, m.start(), m.end())):
                    found.add((sum(m.fuzzy_counts), m.start(), m.end()))
            taken: list[tuple[int, int]] = []
            for count, a, b in sorted(found):
                k = bisect_right(taken, (a, b))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    out.append(Hit(label, a, b, count, len(text)))
        return sorted(out, key=lambda h: (h.start, h.end, h.label))


def _whole_words(joined: str, start: int, end: int) -> str:
    """The words that a span touches, with a blank before and after."""
    last = joined.find(" ", end)
    return f" {joined[joined.rfind(' ', 0, start + 1) + 1 : len(joined) if last < 0 else last]} "


def phrase_hits(joined: str) -> list[Hit]:
    """All places where a phrase's words stand one after the other."""
    out = []
    if "license" not in joined:
        return out
    padded = f" {joined} "
    for phrase, label in PHRASES.items():
        at = padded.find(f" {phrase} ")
        while at >= 0:
            out.append(Hit(label, at, at + len(phrase), 0, len(phrase)))
            at = padded.find(f" {phrase} ", at + 1)
    return sorted(out, key=lambda h: (h.start, h.end))


@lru_cache(maxsize=4)
def searcher(notices: tuple[tuple[str, str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> NoticeSearch:
    return NoticeSearch(notices, chars_per_edit)


def scan_text(text: str, search: NoticeSearch) -> tuple[int, list[Hit], list[Hit], str]:
    """(number of words, phrase hits, notice hits, the joined words)."""
    words = words_of(text)
    joined = b" ".join(words).decode("utf-8", "surrogatepass")
    return len(words), phrase_hits(joined), search.hits(joined), joined


def source_spans(text: str, joined: str, hits: list[Hit]) -> list[tuple[str, int, int, int]]:
    """(label, start, end, edits) in code points of the text itself."""
    if not hits:
        return []
    places = [m.span() for m in _WORD.finditer("".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    starts = [0]
    for a, b in places:
        starts.append(starts[-1] + b - a + 1)
    out = []
    for h in hits:
        first, last = bisect_right(starts, h.start) - 1, bisect_right(starts, max(h.start, h.end - 1)) - 1
        a = places[first][0] + min(h.start - starts[first], places[first][1] - places[first][0])
        b = places[last][0] + min(h.end - starts[last], places[last][1] - places[last][0])
        out.append((h.label, a, b, h.edits))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[tuple[str, str, str], ...] = NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """Per row ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``score`` is the best share of unchanged characters of a hit (1 for an exact one, 0 without any); ``spans`` lists
    label, start, end (code points of the text) and edits of every phrase and notice.
    """

    def make():
        search = searcher(notices, chars_per_edit)

        def run(texts: list[str | None]) -> list[list]:
            out: list[list] = [[] for _ in range(8)]
            for text in texts:
                text = text or ""
                n, base, found, joined = scan_text(text, search)
                first = joined.count(" ", 0, base[0].start) if base else None
                last = joined.count(" ", 0, base[-1].start) if base else None
                score = max((1 - h.edits / h.length for h in base + found), default=0.0)
                spans = [{"label": s[0], "start": s[1], "end": s[2], "edits": s[3]} for s in source_spans(text, joined, base + found)]
                row = (n, len(base), first, last, ",".join(sorted({h.label for h in base})), ",".join(sorted({h.label for h in base + found})), max(0.0, score), spans)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return run

    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    added = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:int,end:int,edits:int>>"
    return map_texts(slim, "text", make, added, ["doc_id"])
