"""Finding secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as begin of a secret, inside, or outside, from their shape, the words around and features of the whole
text, and is decoded by Viterbi.  Two hard constraints are part of the model: a secret holds no white space, and it begins
at a token of 8 or more characters (5, with a digit, after a word like ``password``) that has a digit or such a word shortly before.  Tokens elsewhere can only
be outside, so the lattice falls apart exactly at white space, and words that can't begin a secret need no decoding.

The weights are learned on the driver, in about a second, from TRAINING_LINES labelled lines made by a seeded rule; they
are a few hundred numbers.

Edge cases: a null text counts as empty and has no span; rows are handled one by one, so repeated rows, empty tables and
further columns need no care; matches of one kind don't overlap, spans of the field that overlap a pattern's are left out.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm.common import col, fresh, map_texts

#: Labelled lines that the field is trained on.
TRAINING_LINES = 1600

# The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
MASK = "[SECRET]"

_TOKEN = re.compile(r"[A-Za-z0-9+/_.-]+(?:={1,2}(?![A-Za-z0-9+/_.\"'-]))?|[^\x20\x09-\x0D]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
_DIGIT = re.compile(r"[0-9]")
_KEYWORD = re.compile(r"(?i:passw|passphrase|secret|token|api_?-?key|credential|bearer|private_?-?key|access_?-?key|auth)")
_KEYWORD_PARTS = (b"pass", b"secret", b"token", b"key", b"credential", b"bearer", b"auth")
_PREFIX = re.compile(r"AKIA|ASIA|ghp_|gho_|github_pat_|glpat-|sk-|sk_live_|xox[abp]-|eyJ|AIza|npm_|pypi-")

FEATURES = (
    "bias", "len_8", "len_16", "len_32", "short", "five", "lower", "upper", "digit", "digits_only", "hex", "three_kinds", "switches", "many_switches", "symbols",
    "dotted_number", "prefix", "varied", "punctuation", "after_assign", "after_quote", "key_in_word", "key_1", "key_2", "key_3", "before_colon",
    "at_sign", "url", "first", "doc_key", "doc_code", "wordlike",
)
_AT = {f: i for i, f in enumerate(FEATURES)}
OUT, BEGIN, IN = 0, 1, 2


def base_spans(text: str, low: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _token_features(word: str, tokens: list[re.Match], i: int, before: list[str], doc: tuple[bool, bool]) -> list[int]:
    t = tokens[i][0]
    on = ["bias"]
    n = len(t)
    on.append("len_32" if n >= 32 else "len_16" if n >= 16 else "len_8" if n >= 8 else "short")
    if 5 <= n < 8:
        on.append("five")
    lower, upper, digit = (any(a <= c <= b for c in t) for a, b in ("az", "AZ", "09"))
    on += [f for f, v in (("lower", lower), ("upper", upper), ("digit", digit)) if v]
    if digit and not lower and not upper:
        on.append("digits_only")
    if n >= 16 and digit and re.fullmatch(r"[0-9a-fA-F]+", t):
        on.append("hex")
    if lower and upper and digit:
        on.append("three_kinds")
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:], strict=False))
    on += [f for f, v in (("switches", switches >= 2), ("many_switches", switches >= 5)) if v]
    if re.search(r"[+/_=-]", t):
        on.append("symbols")
    if re.fullmatch(r"[0-9]+([.,/-][0-9]+)+\.?", t):
        on.append("dotted_number")
    if _PREFIX.match(t):
        on.append("prefix")
    if n >= 12 and len(set(t)) >= 10:
        on.append("varied")
    if n == 1 and not t.isalnum():
        on.append("punctuation")
    if re.fullmatch(r"[A-Za-z]?[a-z]*[.,]?", t):
        on.append("wordlike")
    previous = tokens[i - 1][0] if i else ""
    lead = word[: tokens[i].start()]
    if re.search(r"[:=]\W*$", lead) or not i and before and re.search(r"[:=][\"']?$", before[-1]):
        on.append("after_assign")
    if previous in ("'", '"'):
        on.append("after_quote")
    if _KEYWORD.search(lead):
        on.append("key_in_word")
    on += [f"key_{k}" for k in (1, 2, 3) if len(before) >= k and _KEYWORD.search(before[-k])]
    if before and before[-1].endswith(":"):
        on.append("before_colon")
    if "@" in word:
        on.append("at_sign")
    if "://" in word or word.startswith("www."):
        on.append("url")
    if not i:
        on.append("first")
    on += [f for f, v in (("doc_key", doc[0]), ("doc_code", doc[1])) if v]
    return [_AT[f] for f in on]


def _can_begin(feats: list[int]) -> bool:
    f = set(feats)
    key = bool(f & {_AT["key_in_word"], _AT["key_1"], _AT["key_2"], _AT["key_3"]})
    if _AT["short"] in f:
        return key and _AT["digit"] in f and _AT["five"] in f
    return key or _AT["digit"] in f


def _allowed(feats: list[list[int]]) -> np.ndarray:
    """0 where a label is possible, else minus infinity."""
    out = np.full((len(feats), 3), -np.inf)
    out[:, OUT] = 0
    out[1:, IN] = 0
    for i, f in enumerate(feats):
        if _can_begin(f):
            out[i, BEGIN] = 0
    return out


#: Transitions that can't be: inside after outside.
_STEP = np.array([[0, 0, -np.inf], [0, 0, 0], [0, 0, 0]])


class SecretField:
    """Weights of the field: emissions (features x labels) and transitions (labels x labels)."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition + _STEP

    def decode(self, feats: list[list[int]]) -> list[int]:
        """The best labels of a word's tokens; outside stands before and after."""
        score = np.array([self.emission[f].sum(axis=0) for f in feats]) + _allowed(feats)
        best = self.transition[OUT] + score[0]
        back = []
        for row in score[1:]:
            via = best[:, None] + self.transition
            back.append(via.argmax(axis=0))
            best = via.max(axis=0) + row
        label = int((best + self.transition[:, OUT]).argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return out[::-1]

    def word_spans(self, word: str, before: list[str], doc: tuple[bool, bool]) -> list[tuple[int, int]]:
        tokens = list(_TOKEN.finditer(word))
        feats = [_token_features(word, tokens, i, before, doc) for i in range(len(tokens))]
        if not any(map(_can_begin, feats)):
            return []
        out: list[tuple[int, int]] = []
        for t, label in zip(tokens, self.decode(feats), strict=True):
            if label == BEGIN:
                out.append((t.start(), t.end()))
            elif label == IN and out:
                out[-1] = (out[-1][0], t.end())
        return out

    def spans(self, text: str, low: bytes | None = None) -> list[tuple[int, int]]:
        """(start, end) of the secrets that the field finds in a text."""
        low = text.encode("utf-8", "surrogatepass").lower() if low is None else low
        keyed = any(k in low for k in _KEYWORD_PARTS)
        if not keyed and not _DIGIT.search(text):
            return []
        doc = (keyed, any(c in text for c in "{};"))
        out, at = [], 0
        places = _key_or_digit(text) if keyed else (m.start() for m in _DIGIT.finditer(text))
        for p in places:
            if p < at:
                continue
            start = _word_start(text, p)
            found = _SPACE.search(text, p)
            at = found.start() if found else len(text)
            out += [(start + a, start + b) for a, b in self.word_spans(text[start:at], _words_before(text, start), doc)]
        return out


def _word_start(text: str, p: int) -> int:
    start = 0
    for c in " \n\t\r\v\f":
        start = max(start, text.rfind(c, start, p) + 1)
    return start


def _words_before(text: str, start: int) -> list[str]:
    """The three words before ``start``, whole however long they or the gaps between them are."""
    size = 120
    while True:
        words = text[max(0, start - size) : start].split()
        if size >= start or len(words) > 3:
            return words[-3:]
        size *= 2


def _key_or_digit(text: str) -> Iterator[int]:
    """Places in words that may begin a secret: words with a digit, and the words from a keyword to the third after it."""
    places = {m.start() for m in _DIGIT.finditer(text)}
    for m in _KEYWORD.finditer(text):
        at = m.start()
        for _ in range(4):
            places.add(at)
            gap = re.compile(r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]+").match(text, at)
            if not gap or gap.end() >= len(text):
                break
            at = gap.end()
    return iter(sorted(places))


def training_lines(count: int = TRAINING_LINES, seed: int = 11) -> list[tuple[str, str]]:
    """(line, its secret or "") by a seeded rule."""
    rng = np.random.default_rng(seed)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: pick(low, int(rng.integers(1, 4))) + pick("aeiou", 1) + pick(low, int(rng.integers(0, 5)))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    digits = lambda a, b: pick(num, int(rng.integers(a, b)))
    secrets = (
        lambda: pick(low + up + num, int(rng.integers(16, 44))),
        lambda: pick(low + up + num + "+/", int(rng.integers(20, 60))) + "=",
        lambda: pick("0123456789abcdef", int(rng.choice([24, 28, 32, 40, 64]))),
        lambda: str(rng.choice(["ghp_", "sk-", "glpat-", "npm_", "xoxb-", "AIza"])) + pick(low + up + num, int(rng.integers(20, 40))),
        lambda: "eyJ" + pick(low + up + num, 20) + "." + pick(low + up + num, 30) + "." + pick(low + up + num + "_-", 30),
        lambda: pick(low, 4) + pick(num, 2) + pick("!@$%&", 1) + pick(low + up, 4) + pick(num, 2),
    )
    harmless = (
        lambda: digits(2, 5), lambda: digits(16, 17), lambda: ".".join(digits(1, 4) for _ in range(4)), lambda: f"+{digits(1, 3)} ({digits(3, 4)}) {digits(3, 4)}-{digits(4, 5)}",
        lambda: f"{word()}.{word()}{digits(1, 4)}@{word()}.com", lambda: f"{digits(4, 5)}-{digits(2, 3)}-{digits(2, 3)}", lambda: f"https://{word()}.org/{word()}/{digits(3, 9)}?id={digits(4, 9)}",
        lambda: f"{word()}_{digits(4, 7)}.pdf", lambda: f"v{digits(1, 2)}.{digits(1, 3)}.{digits(1, 3)}-beta{digits(1, 2)}", lambda: f"{digits(1, 4)},{digits(3, 4)}.{digits(2, 3)}", lambda: f"{word()}{digits(1, 4)}{word()}s",
        lambda: f"ISBN {digits(3, 4)}-{digits(1, 2)}-{digits(4, 6)}-{digits(3, 5)}-{digits(1, 2)}", lambda: word().upper() + digits(6, 12),
    )
    key = ("password", "DB_PASSWORD", "client_secret", "token", "access_token", "api_key", "apikey", "credential", "secret_key", "auth")
    frames = ('{k} = "{s}"', "{k}: {s}", "{k}={s}", "'{k}' : '{s}'", "export {k}={s}", "Authorization: Bearer {s}", "the {k} is {s}", "{k} {s}", "{s}", "use {s} as {k}")
    out = []
    for i in range(count):
        head, tail = words(0, 6), words(0, 5)
        if i % 2:
            kind = int(rng.integers(0, len(secrets)))
            s = secrets[kind]()
            frame = str(rng.choice(frames[:8])) if kind in (0, 1, 2, 5) else str(rng.choice(frames))
            out.append((f"{head} {frame.format(k=rng.choice(key), s=s)} {tail}", s))
        else:
            middle = harmless[int(rng.integers(0, len(harmless)))]() if i % 4 else words(2, 6)
            if i % 8 == 2:
                middle = f"{rng.choice(key)} {middle}"
            out.append((f"{head} {middle} {tail}{rng.choice(['.', '', ','])}", ""))
    return out


def _labelled(lines: list[tuple[str, str]]) -> list[tuple[list[list[int]], list[int]]]:
    out = []
    for line, secret in lines:
        place = line.find(secret) if secret else -1
        low = line.encode().lower()
        doc = (any(k in low for k in _KEYWORD_PARTS), any(c in line for c in "{};"))
        for m in re.finditer(r"[^\x20\x09-\x0D]+", line):
            tokens = list(_TOKEN.finditer(m[0]))
            feats = [_token_features(m[0], tokens, i, _words_before(line, m.start()), doc) for i in range(len(tokens))]
            if not any(map(_can_begin, feats)):
                continue
            labels = [OUT] * len(tokens)
            inside = [i for i, t in enumerate(tokens) if place >= 0 and place <= m.start() + t.start() < place + len(secret)]
            if inside and _can_begin(feats[inside[0]]):
                for i in inside:
                    labels[i] = IN
                labels[inside[0]] = BEGIN
            out.append((feats, labels))
    return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(lines: list[tuple[str, str]], rounds: int = 150, rate: float = 0.15, decay: float = 2e-3) -> SecretField:
    """Maximises the conditional likelihood (forward-backward over all words at once, Adam steps)."""
    data = _labelled(lines)
    n, longest = len(data), max(len(f) for f, _ in data)
    x = np.zeros((n, longest, len(FEATURES)))
    mask = np.zeros((n, longest), bool)
    gold = np.zeros((n, longest), int)
    allowed = np.full((n, longest, 3), -np.inf)
    allowed[:, :, OUT] = 0
    for w, (feats, labels) in enumerate(data):
        for i, f in enumerate(feats):
            x[w, i, f] = 1
        mask[w, : len(feats)] = True
        gold[w, : len(feats)] = labels
        allowed[w, : len(feats)] = _allowed(feats)
    # padding can only be outside and has no feature, so that it stands for the end
    step = np.concatenate([np.zeros((n, 1), int), gold], axis=1)
    ends = np.concatenate([step, np.zeros((n, 1), int)], axis=1)
    gold_steps = np.zeros((3, 3))
    np.add.at(gold_steps, (ends[:, :-1].ravel(), ends[:, 1:].ravel()), 1)
    gold_emit = np.einsum("ntf,ntl->fl", x, np.eye(3)[gold] * mask[:, :, None])
    params = [np.zeros((len(FEATURES), 3)), np.zeros((3, 3))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for turn in range(1, rounds + 1):
        emission, transition = params[0], params[1] + _STEP
        score = x @ emission + allowed
        forward, backward = np.empty_like(score), np.empty_like(score)
        forward[:, 0] = transition[OUT] + score[:, 0]
        for t in range(1, longest):
            forward[:, t] = _logsum(forward[:, t - 1, :, None] + transition, 1) + score[:, t]
        backward[:, -1] = transition[:, OUT]
        for t in range(longest - 2, -1, -1):
            backward[:, t] = _logsum(transition + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        z = _logsum(forward[:, -1] + transition[:, OUT], 1)
        p = np.exp(forward + backward - z[:, None, None])
        emit = np.einsum("ntf,ntl->fl", x, p * mask[:, :, None])
        steps = np.zeros((3, 3))
        steps[OUT] += p[:, 0].sum(axis=0)
        steps[:, OUT] += p[:, -1].sum(axis=0)
        for t in range(1, longest):
            steps += np.exp(forward[:, t - 1, :, None] + transition + (score[:, t] + backward[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        for k, gradient in enumerate(((gold_emit - emit) / n - decay * params[0], (gold_steps - steps) / n - decay * params[1])):
            first[k] = 0.9 * first[k] + 0.1 * gradient
            second[k] = 0.99 * second[k] + 0.01 * gradient**2
            params[k] = params[k] + rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)
    return SecretField(*params)


@lru_cache(maxsize=1)
def default_field() -> SecretField:
    return train(training_lines())


def all_spans(text: str, field: SecretField) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' spans and of those the field adds, sorted."""
    low = text.encode("utf-8", "surrogatepass").lower()
    base = base_spans(text, low)
    # base spans by start, and how far those up to each reach
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    apart = lambda a, b: (k := bisect_left(starts, b)) == 0 or reach[k - 1] <= a
    extra = [(a, 3, b) for a, b in field.spans(text, low) if apart(a, b)]
    return sorted(base + extra)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones joined, replaced by MASK."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], MASK]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: SecretField | None = None) -> DataFrame:
    """Per row ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added, masked``."""
    field = field or default_field()

    def run(texts: list[str | None]) -> list[list]:
        out: list[list] = [[] for _ in range(7)]
        for text in texts:
            text = text or ""
            spans = all_spans(text, field)
            n = [sum(k == kind for _, k, _ in spans) for kind in range(4)]
            base = written([s for s in spans if s[1] < 3])
            for column, value in zip(out, (*n[:3], hashlib.sha256(base.encode()).hexdigest(), written(spans), n[3], masked(text, spans)), strict=True):
                column.append(value)
        return out

    slim = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    return map_texts(slim, "text", lambda: run, "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_added bigint, masked string", ["doc_id"])


def mask_secrets(docs: DataFrame, text_col: str = "text", field: SecretField | None = None) -> DataFrame:
    """``docs`` with every secret in the text replaced by MASK; null texts stay null."""
    field = field or default_field()
    own = fresh(docs, "_masked")
    run = lambda texts: [[masked(t, all_spans(t, field)) if t else t for t in texts]]
    others = [c for c in docs.columns if c != text_col]
    out = map_texts(docs, text_col, lambda: run, f"{own} string", others)
    return out.select(*(col(own).alias(c) if c == text_col else col(c) for c in docs.columns))
