"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut in blocks at block-level tags.  Each block is described by its number of words and link density and those of the
blocks before and after it, and by what its containers say (an article, a menu, a comment list ...).  A decision tree,
trained on the small table of labelled blocks of ``training_pages``, keeps the article's blocks.  Half of these pages have
no telling tags or classes, and some have lists of links within the article, so that words and link densities decide there.

Edge cases: null html counts as empty and gives an empty text; broken markup (tags left open, stray end tags) is read as
browsers would, roughly; markup that never ends is text; scripts, styles and comments are dropped whatever they contain,
to the end of the page if they are left open; an open ``video``, ``svg`` or the like drops nothing; pages are read in time
in proportion to their length, whatever they hold, and one by one, so that repeated rows, empty tables and further
columns need no care; nothing is cut off.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidewright.llm.common import col, map_texts

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_BARE_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)

#: Elements whose content is not text of the page: to its end if they are left open, and not at all then.
RAW = {"script", "style", "iframe", "textarea", "title", "noframes", "xmp"}
EMBEDDED = {"noscript", "template", "svg", "object", "math", "canvas", "audio", "video"}
#: Elements that begin and end a block.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul label".split())
#: Those of them that can hold others and so are kept on a stack.
HOLDERS = BLOCK - {"p", "hr", "option", "label"}
_VOID = {"hr"}

_BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "select", "fieldset", "dialog", "menu", "option", "label"}
_BOILER_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead topbar toolbar ad ads advert adverts advertisement advertising banner promo promotion sponsored sponsor cookie cookies consent gdpr notice notices alert disclaimer copyright legal share sharing social related recommended recommendations newsletter subscribe subscription popup modal overlay widget login signup search pagination pager tags tagcloud skip".split()
)
_COMMENT_WORDS = set("comment comments reply replies respond discussion disqus commentlist".split())
_ARTICLE_WORDS = set("article content post entry story main body articlebody text maincontent".split())
_ROLES = {"navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form"}

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler", "comment", "heading", "item", "legal")
_LEGAL = re.compile(r"©|\(c\) ?[12][0-9]{3}|copyright|rights reserved", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    link_words: int
    article: bool
    boiler: bool
    comment: bool
    tag: str
    label: int | None = field(default=None)


@dataclass
class _Holder:
    tag: str
    article: bool
    boiler: bool
    comment: bool


def _enter(tag: str, attributes: str, above: _Holder) -> _Holder:
    words: set[str] = set()
    for m in _ATTRIBUTE.finditer(attributes):
        words |= {_ROLES.get(w, w) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())}
    comment = above.comment or bool(words & _COMMENT_WORDS)
    boiler = above.boiler or tag in _BOILER_TAGS or tag == "header" and not above.article or bool(words & _BOILER_WORDS) and tag not in ("body", "html", "article", "main", "h1")
    article = above.article or tag in ("article", "main") or bool(words & _ARTICLE_WORDS) and tag not in ("body", "html")
    return _Holder(tag, article, boiler, comment)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order."""
    out: list[Block] = []
    stack = [_Holder("", False, False, False)]
    parts: list[tuple[str, bool]] = []
    tag_now, in_link, at = "", False, 0
    open_tags: Counter[str] = Counter()
    never: set[str] = set()  # ends that don't come any more

    def close() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(t for t, _ in parts)).split())
            if text:
                linked = sum(len(html_lib.unescape(t).split()) for t, link in parts if link)
                top = stack[-1]
                out.append(Block(text, text.count(" ") + 1, linked, top.article, top.boiler, top.comment, tag_now or top.tag))
            parts.clear()

    def find(what: str, at: int) -> int:
        found = -1 if what in never else page.find(what, at)
        if found < 0:
            never.add(what)
        return found

    def end_of(tag: str, at: int) -> int:
        """Behind the next end tag of ``tag``, or -1; upper and lower case count as one."""
        if f"</{tag}" in never:
            return -1
        stop = _end_tag(tag).search(page, at)
        if stop is None:
            never.add(f"</{tag}")
            return -1
        return stop.end()

    while at < len(page):
        begins = _OPENING.search(page, at)
        if begins is None:
            parts.append((page[at:], in_link))
            break
        start = begins.start()
        if start > at:
            parts.append((page[at:start], in_link))
        if page.startswith("<!--", start):
            end = find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        m = None
        if page[start + 1 : start + 2] in ("!", "?"):
            end = find(">", start)
        else:
            if "quotes" not in never and (m := _TAG.match(page, start)) is None and _OPEN_TAG.match(page, start):
                never.add("quotes")  # a quote stays open to the end of the page: from here on they mean nothing
            if m is None and ">" not in never and (m := _BARE_TAG.match(page, start)) is None and _OPEN_TAG.match(page, start):
                never.add(">")
            end = m.end() - 1 if m else -1
        if end < 0:
            parts.append((page[start : start + 1], in_link))
            at = start + 1
            continue
        at = end + 1
        if m is None:
            continue
        tag, ends = m[2].lower(), bool(m[1])
        if tag in RAW or tag in EMBEDDED:
            if not ends and not m[3].endswith("/"):
                end = end_of(tag, at)
                at = end if end >= 0 else len(page) if tag in RAW else at
        elif tag == "a":
            in_link = not ends
        elif tag == "br":
            parts.append((" ", in_link))
        elif tag in BLOCK:
            close()
            tag_now = "" if ends else tag
            if ends:
                in_link = False
                while open_tags[tag]:
                    gone = stack.pop().tag
                    open_tags[gone] -= 1
                    if gone == tag:
                        break
            elif tag in HOLDERS and tag not in _VOID:
                if tag == "li" and stack[-1].tag == "li" or tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag == tag:
                    open_tags[stack.pop().tag] -= 1
                stack.append(_enter(tag, m[3], stack[-1]))
                open_tags[tag] += 1
    close()
    return out


_OPENING, _OPEN_TAG = re.compile(r"<(?=/?[a-zA-Z]|[!?])"), re.compile(r"</?[a-zA-Z]")


@lru_cache(maxsize=64)
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?:\s[^>]*)?>", re.IGNORECASE)


def features_of(blocks: list[Block]) -> np.ndarray:
    """(blocks, FEATURES): what the tree sees."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.link_words for b in blocks], float) / words
    out[:, 0], out[:, 1] = words, links
    out[1:, 2], out[1:, 3] = words[:-1], links[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], links[1:]
    for i, b in enumerate(blocks):
        heading = len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()
        out[i, 6:] = (b.article, b.boiler, b.comment, heading, b.tag in ("li", "td", "th", "dt", "dd"), bool(_LEGAL.search(b.text)))
    return out


class Tree:
    """A binary decision tree, grown by the Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 3):
        self.rule: tuple[int, float] | None = None
        self.keep = bool(y.mean() >= 0.5) if len(y) else False
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1 and (best := self._best(x, y, least)):
            f, cut = best
            low = x[:, f] <= cut
            self.low, self.high = Tree(x[low], y[low], depth - 1, least), Tree(x[~low], y[~low], depth - 1, least)
            if not (self.low.rule is None and self.high.rule is None and self.low.keep == self.high.keep):
                self.rule = best

    @staticmethod
    def _best(x: np.ndarray, y: np.ndarray, least: int) -> tuple[int, float] | None:
        n, best, found = len(y), y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            left, right = ones[:-1], ones[-1] - ones[:-1]
            cost = left * (k - left) / k + right * (n - k - right) / (n - k)
            cost[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = np.inf
            at = int(cost.argmin())
            if cost[at] < best:
                best, found = cost[at], (f, float((v[at] + v[at + 1]) / 2))
        return found

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.rule is None:
            return np.full(len(x), self.keep)
        out = np.empty(len(x), bool)
        low = x[:, self.rule[0]] <= self.rule[1]
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


def training_pages(count: int = 240, seed: int = 3, telling: float = 0.5) -> list[tuple[str, list[str]]]:
    """(html, the article's blocks) by a seeded rule: a share of ``telling`` pages has tags and classes that say what is what."""
    rng = np.random.default_rng(seed)
    pool = np.array(["".join(rng.choice(list("aeilnorst"), int(rng.integers(2, 9)))) for _ in range(500)])
    say = lambda a, b, end=".": " ".join(pool[rng.integers(0, len(pool), int(rng.integers(a, b)))]) + end
    links = lambda a, b: "".join(f'<li><a href="/{i}">{say(1, 5, "")}</a></li>' for i in range(int(rng.integers(a, b))))
    line = lambda a, b: " ".join(f'<a href="/{i}">{say(1, 5, "")}</a>' for i in range(int(rng.integers(a, b))))
    pick = lambda *made: made[int(rng.integers(len(made)))]()
    # menus and lists of links: items, one long block, or one with some words around the links
    menu = lambda: pick(lambda: f"<ul>{links(3, 9)}</ul>", lambda: f"<div>{line(3, 20)}</div>", lambda: f"<p>{line(2, 12)}</p>", lambda: f"<div>{say(1, 5, ':')} {line(4, 16)}</div>")
    legal = lambda: f"&copy; {int(rng.integers(1990, 2030))} {say(1, 12)} {rng.choice(['All rights reserved.', '', say(1, 9)])}"
    foot = lambda: pick(legal, lambda: f"{legal()} {line(1, 6)}", lambda: f"{say(1, 8, '')} {line(2, 9)}", lambda: f"Copyright {say(2, 20)}")

    def paragraph(a: int, b: int) -> tuple[str, str]:
        """(html, text) of a paragraph, of which some have links."""
        words = say(a, b).split(" ")
        shown = list(words)
        if len(words) > 8 and rng.random() < 0.4:
            for _ in range(int(rng.integers(1, 4))):
                k = int(rng.integers(len(words)))
                shown[k] = f'<a href="/{k}">{words[k]}</a>'
        return f"<p>{' '.join(shown)}</p>", " ".join(words)

    out = []
    for _ in range(count):
        says = rng.random() < telling
        title = say(1, 16, str(rng.choice(["", "."])))
        made = [paragraph(1, 16) if says and rng.random() < 0.5 else paragraph(14, 90) for _ in range(int(rng.integers(2, 8)))]
        body = [f"<h1>{title}</h1>", *(h for h, _ in made)]
        # short paragraphs between long ones belong to an article without tags too
        if not says and len(made) > 2 and rng.random() < 0.4:
            text = say(2, 12)
            made[1:1], body[2:2] = [("", text)], [f"<p>{text}</p>"]
        if says and rng.random() < 0.5:  # lines of law within an article are its own
            text = rng.choice(["All rights reserved.", f"Copyright {say(1, 12)}"])
            made.append(("", text))
            body.append(f"<p>{text}</p>")
        if rng.random() < 0.25:  # some articles have no title
            title, body = "", body[1:]
        if rng.random() < 0.5:  # links to other pages, in the middle of the article
            body.insert(int(rng.integers(1, len(body) + 1)), menu())
        if says:
            noise = pick(lambda: "", lambda: f'<section id="comments"><p>{say(5, 70)}</p><p>{say(2, 30)}</p></section>', lambda: f"<aside><p>{say(8, 60)}</p></aside>", lambda: f'<div class="share"><span>{say(2, 6, "")}</span></div>', lambda: f'<div class="newsletter">{say(8, 40)}</div>')
            body.insert(int(rng.integers(1, len(body) + 1)), noise)
            before = pick(lambda: f"<nav>{menu()}</nav>", lambda: f'<header><p>{say(1, 40)}</p></header><div class="menu">{menu()}</div>', lambda: f'<div id="cookie-notice"><p>{say(10, 60)}</p></div><div class="ad">{say(4, 40)}</div>', lambda: f'<div class="ad">{say(5, 50)}</div>', menu)
            after = pick(lambda: f"<footer>{pick(foot, lambda: say(1, 60))}</footer>", lambda: f'<div class="comments"><div>{say(10, 80)}</div><div>{say(2, 20)}</div></div><footer><p>{say(1, 40)}</p></footer>', lambda: f"<aside><p>{say(1, 80)}</p>{menu()}</aside>", lambda: f'<form><label>{say(1, 4, "")}</label><button>{say(1, 2, "")}</button></form><footer>{foot()}</footer>', lambda: f"{menu()}<div>{foot()}</div>")
            wrap = pick(lambda: "<article>{}</article>", lambda: '<main><div class="post-content">{}</div></main>', lambda: '<div class="article-body">{}</div>')
        else:
            before = pick(menu, lambda: f"{menu()}<div>{say(1, 9, '')}</div>", lambda: f"<div>{say(1, 6, '')}</div>{menu()}")
            after = pick(lambda: f"<div>{foot()}</div>", lambda: f"{menu()}<div>{foot()}</div>", lambda: f"{menu()}<div>{say(1, 8, '')}</div>", lambda: f"{menu()}<p>{say(3, 22)}</p>", menu)
            wrap = "<div>{}</div>"
        # a third of the pages begin or end with the article
        before, after = ("" if rng.random() < 0.33 else x for x in (before, after))
        out.append((f"<html><body>{before}{wrap.format(''.join(body))}{after}</body></html>", [t for t in (title, *(t for _, t in made)) if t]))
    return out


def training_table(pages: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of labelled pages."""
    x, y = [], []
    for page, article in pages:
        blocks = blocks_of(page)
        x.append(features_of(blocks))
        y += [b.text in set(article) for b in blocks]
    return np.concatenate(x), np.array(y, float)


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return Tree(*training_table(training_pages()))


def main_text(page: str | None, tree: Tree) -> str:
    """The kept blocks, joined by line feeds."""
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    keep = tree.predict(features_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: Tree | None = None) -> DataFrame:
    """Per page ``page_id, url, text, n_chars``."""
    tree = tree or default_tree()

    def run(htmls: list[str | None]) -> tuple[list, ...]:
        text = [main_text(h, tree) for h in htmls]
        return text, [len(t) for t in text]

    slim = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), col(html_col).alias("html"))
    return map_texts(slim, "html", lambda: run, "text string, n_chars bigint", ["page_id", "url"])
