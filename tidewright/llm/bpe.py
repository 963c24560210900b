"""BPE encoding by dynamic programming over prefixes, and decoding.

For a word, every prefix has exactly one last token in its encoding: among the tokens that end there (the suffixes of the
prefix that an automaton over the vocabulary finds), the one that is compatible with the last token of the prefix before it.
Two tokens are compatible if the merges, applied to their joint characters, give back these two tokens.  The last tokens are
stored for each prefix and the ids are read off by following them back from the end.

The tokenizer's file gives the vocabulary, the merges, the special tokens and the steps before BPE (NFC, lower case, splitting,
bytes as characters, word ends).  Words are encoded once for each Python worker as long as they are in a table of at most
``MEMO_WORDS`` entries.

Edge cases: a null text counts as empty (no ids, hash of the empty string); special tokens in a text are matched first, as the
library does; very long words take time in proportion to their length; rows are handled one by one, so repeated rows,
empty tables and further columns need no care.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidewright.llm.common import col, map_texts

#: Words (between white space) and pieces whose encodings a Python worker keeps: the latest so many, and the generation
#: before, from which words that come up again are taken over.
MEMO_WORDS = 150_000
#: The longest word that is kept.
MEMO_CHARS = 64
#: Pairs of tokens whose compatibility a worker keeps.
MEMO_PAIRS = 250_000

_END = ""  # stands for the word end; mapped bytes never contain it
_NEVER = 1 << 60


def _byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class BpeEncoder:
    """Ids and tokens of texts under one tokenizer file."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        self.memo_words = memo_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        inner = lambda t: t[: -len(suffix)] + _END if suffix and t.endswith(suffix) else t
        self.ids = {inner(t): i for t, i in self.vocab.items()}
        self.shown = {i: t for t, i in self.vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(self.ids[inner(a)], self.ids[inner(b)]): (r, self.ids[inner(a + b)]) for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.shown |= {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(_split_pattern(spec))
        self.newer, self.lowered = _table_differences(path, self.pieces)
        self.first_newer = chr(min([*self.newer, *self.lowered], default=0x110000 - 1))
        self.chars = _byte_chars()
        self.token_of = {i: t for t, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.texts = {i: str(i) for i in self.shown}
        #: Whether a token may follow: by the token before, and at the start of a word.
        self.after: dict[int, dict[int, bool]] = {}
        self.first: dict[int, bool] = {}
        self.pairs = 0
        self.spines: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self.made_by = {made: (rank, a, b) for (a, b), (rank, made) in self.ranks.items()}
        self.memo: dict[str, tuple[str, int, str]] = {}
        self.words: dict[str, tuple[str, int, str]] = {}
        self.old_memo: dict[str, tuple[str, int, str]] = {}
        self.old_words: dict[str, tuple[str, int, str]] = {}

    def symbols(self, text: str) -> list[int]:
        """Ids of the single characters; the word end belongs to the last one."""
        if text.endswith(_END):
            return [self.ids[c] for c in text[:-2]] + [self.ids[text[-2:]]]
        return [self.ids[c] for c in text]

    def merged(self, text: str) -> list[int]:
        """The encoding by merging itself; used for pairs of tokens only, which are short."""
        out = self.symbols(text)
        while len(out) > 1:
            rank, at = min(((self.ranks.get(p, (_NEVER, 0))[0], k) for k, p in enumerate(zip(out, out[1:], strict=False))), default=(_NEVER, 0))
            if rank == _NEVER:
                break
            out[at : at + 2] = [self.ranks[out[at], out[at + 1]][1]]
        return out

    def spine(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The token and its parts at its right and at its left edge, each with the rank of the merge that ends it."""
        known = self.spines.get(token)
        if known is None:
            known = self.spines[token] = ([], [])
            for side in (0, 1):
                part, ends = token, _NEVER
                while True:
                    known[side].append((part, ends))
                    if part not in self.made_by:
                        break
                    ends, first, second = self.made_by[part]
                    part = first if side else second
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the characters of both tokens leaves just these two.

        It does unless some part at the right edge of ``a`` and some part at the left edge of ``b`` have a merge that comes
        before the merges which end these parts; among equal ranks the leftmost merge comes first.
        """
        ranks = self.ranks
        for x, x_ends in self.spine(a)[0]:
            for y, y_ends in self.spine(b)[1]:
                merge = ranks.get((x, y))
                if merge is not None and merge[0] < x_ends and merge[0] <= y_ends:
                    return False
        return True

    def fit(self, before: int, token: int, row: dict[int, bool]) -> bool:
        """Decides and stores whether ``token`` may follow ``before`` (-1: the start); ``row`` holds what is known of that."""
        if self.pairs >= MEMO_PAIRS:
            for known in [self.first, *self.after.values()]:
                known.clear()
            self.pairs = 0
        self.pairs += 1
        row[token] = fits = self.merged(self.token_of[token]) == [token] if before < 0 else self.compatible(before, token)
        return fits

    def encode_word(self, piece: str) -> list[int]:
        """Ids of one piece of a text, by the last token of every prefix."""
        if piece.isalnum() and piece.isascii():
            text = piece + _END
        else:
            chars = self.chars
            text = "".join([chars[b] for b in piece.encode("utf-8", "surrogatepass")]) + _END
        n_chars = len(text)
        last = [-1] * (n_chars + 1)
        size = [0] * (n_chars + 1)
        # what may follow each prefix whose last token is known
        rows: list[dict[int, bool] | None] = [None] * (n_chars + 1)
        rows[0] = self.first
        after = self.after
        for at, (n, token) in self.automaton.iter(text):
            end = at + 1
            if rows[end] is None:
                row = rows[end - n]
                if row is not None:
                    fits = row.get(token)
                    if fits is None:
                        fits = self.fit(last[end - n], token, row)
                    if fits:
                        last[end] = token
                        size[end] = n
                        following = after.get(token)
                        if following is None:
                            following = after[token] = {}
                        rows[end] = following
        out, at = [], n_chars
        if rows[at] is None and at:
            raise ValueError(f"the vocabulary has no tokens for {piece!r}")
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def _entry(self, piece: str) -> tuple[str, int, str]:
        entry = self.old_memo.get(piece)
        if entry is None:
            ids = self.encode_word(piece)
            texts, shown = self.texts, self.shown
            entry = (" ".join([texts[i] for i in ids]), len(ids), " ".join([shown[i] for i in ids]))
        if len(piece) <= MEMO_CHARS:
            if len(self.memo) >= self.memo_words:
                self.memo, self.old_memo = {}, self.memo
            self.memo[piece] = entry
        return entry

    def split(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """(special id, []) or (None, pieces) in text order."""
        for part in self.special_split.split(text) if self.special_split else [text]:
            if part in self.special:
                yield self.special[part], []
            elif part:
                part = normalised(part)
                if part.isascii() or max(part) < self.first_newer:
                    yield None, self.pieces.findall(part)
                else:
                    part = part.translate(self.lowered)
                    yield None, [part[m.start() : m.end()] for m in self.pieces.finditer(part.translate(self.newer))]

    def pieces_of(self, text: str) -> list[tuple[str, int, str]]:
        """(ids, number of ids, tokens) of each piece; ids and tokens joined by a blank."""
        out: list[tuple[str, int, str]] = []
        for special, pieces in self.split(text):
            if special is not None:
                out.append((str(special), 1, self.shown[special]))
            else:
                out += [self.memo.get(p) or self._entry(p) for p in pieces]
        return out

    def _word(self, word: str) -> tuple[str, int, str]:
        made = self.old_words.get(word)
        if made is None:
            stem, tail = (word[:-1], word[-1]) if word[-1] in ".,;:!?" else (word, "")
            low = normalised(stem)
            if stem.isalpha() and low.isalpha():  # letters and at most one mark, as most words are
                parts = [self.memo.get(low) or self._entry(low)]
                if tail:
                    parts.append(self.memo.get(tail) or self._entry(tail))
            else:
                parts = self.pieces_of(word)
            made = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), sum([p[1] for p in parts]), " ".join([p[2] for p in parts]))
        if len(word) <= MEMO_CHARS:
            if len(self.words) >= self.memo_words:
                self.words, self.old_words = {}, self.words
            self.words[word] = made
        return made

    def encoded(self, text: str) -> list[tuple[str, int, str]]:
        """As ``pieces_of``, for each stretch between white space, which always ends a piece and yields none."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space, the tokenizer doesn't
            return self.pieces_of(text)
        words = text.split()
        found = list(map(self.words.get, words))
        if None in found:
            found = [e or self.words.get(w) or self._word(w) for e, w in zip(found, words, strict=True)]
        return found

    def encode(self, text: str) -> list[int]:
        return [int(i) for e in self.encoded(text) for i in e[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by a blank: the file names no decoder."""
        return " ".join([self.shown[i] for i in ids])


#: White space of Unicode, as the library's patterns have it.
_UNICODE_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0  -     　"


def _split_pattern(spec: dict) -> str:
    """The pattern whose matches are the pieces, for the regex library."""
    steps = spec["pre_tokenizer"]["pretokenizers"]
    pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
    return pattern.replace(r"[^\s", "[^" + _UNICODE_SPACE)


def _table_differences(path: str, pieces: regex.Pattern) -> tuple[dict[int, str], dict[int, str]]:
    """Where the tokenizer's Unicode tables differ from those here, among code points unassigned in Python's.

    Code points that split otherwise, mapped to a private one that is neither letter nor digit; and those with another
    lower case, mapped to it.
    """
    library = Tokenizer.from_file(path)
    split, lowered = {}, {}
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    for c in regex.findall(r"[\p{L}\p{N}]", every):
        if unicodedata.category(c) == "Cn":
            other = library.normalizer.normalize_str(c)
            if other != normalised(c):
                lowered[ord(c)] = other
            ends = [b for _, (_, b) in library.pre_tokenizer.pre_tokenize_str("a" + c)]
            if ends != [m.end() for m in pieces.finditer("a" + c)]:
                split[ord(c)] = "\ue000"
    return split, lowered


def normalised(text: str) -> str:
    """NFC, then each character in lower case by itself (a final sigma is not special)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


_encoders: dict[tuple[str, int], BpeEncoder] = {}


def encoder(path: str, memo_words: int = MEMO_WORDS) -> BpeEncoder:
    """The encoder of this process for a tokenizer file."""
    key = (path, memo_words)
    if key not in _encoders:
        _encoders[key] = BpeEncoder(path, memo_words)
    return _encoders[key]


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the ids and of the text decoded from them."""

    def make():
        enc = encoder(path)

        def run(texts: list[str | None]) -> tuple[list, ...]:
            ns, a, b = [], [], []
            for text in texts:
                parts = enc.encoded(text) if text else []
                ids, n, tokens = zip(*parts, strict=True) if parts else ((), (), ())
                ns.append(sum(n))
                a.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                b.append(hashlib.sha256(" ".join(tokens).encode("utf-8", "surrogatepass")).hexdigest())
            return ns, a, b

        return run

    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return map_texts(slim, "text", make, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ["doc_id"])


def encode_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, memo_words: int = MEMO_WORDS, digest: bool = False) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids, decoded``; ``decoded`` is null without ``decode``; with ``digest`` it is ``decoded_sha256``, so that no decoded text leaves the worker.

    ``memo_words`` trades a worker's memory for time.
    """

    def make():
        enc = encoder(path, memo_words)

        def run(texts: list[str | None]) -> tuple[list, ...]:
            ns, ids, decoded = [], [], []
            for text in texts:
                parts = enc.encoded(text) if text else []
                ns.append(sum(p[1] for p in parts))
                ids.append(np.fromstring(" ".join([p[0] for p in parts]), np.int32, sep=" ") if parts else np.empty(0, np.int32))
                shown = " ".join([p[2] for p in parts]) if decode else None
                decoded.append(hashlib.sha256(shown.encode("utf-8", "surrogatepass")).hexdigest() if digest and decode else shown)
            return ns, ids, decoded

        return run

    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return map_texts(slim, "text", make, f"n_tokens bigint, ids array<int>, {'decoded_sha256' if digest else 'decoded'} string", ["doc_id"])
