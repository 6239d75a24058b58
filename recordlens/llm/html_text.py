"""Main text of web pages: the contiguous region whose words outweigh its tags most."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text.
RAW = ("script", "style", "template", "noscript", "iframe", "svg", "textarea", "select", "title")
#: Elements around the main text, not in it.
ASIDE = {"nav", "footer", "aside", "form", "button", "dialog", "head", "menu", "header"}
#: Elements that don't end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn",
          "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
          "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "input"}
#: Elements that are never closed.
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
         "track", "wbr"}
#: Elements that end whatever is still open inside them.
FRAMES = {"html", "body", "div", "section", "article", "main", "nav", "footer", "aside", "form",
          "header", "table", "ul", "ol", "dialog", "menu", "head", "blockquote", "p", "li", "td"}
#: Words of class, id or role that name navigation, adverts, notices, forms and comments.
HINT = re.compile(
    r"ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|"
    r"disqus|footer|login|masthead|menu|nav|navbar|navigation|newsletter|notices?|pagination|"
    r"pager|popup|modal|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|"
    r"signup|skip|social|sponsor\w*|subscribe|subscription|toolbar|widget|complementary|"
    r"contentinfo|alert|disclaimer")
#: Words beside them in such a name. With any other word it names something else
#: ("comments-open", "has-sidebar", "share-price").
BESIDE = re.compile(
    r"\d+|area|bar|block|body|bottom|box|button|buttons|container|content|desktop|fixed|form|group|"
    r"holder|icons?|inner|item|items|layer|left|links?|list|main|mobile|outer|overlay|page|panel|"
    r"posts?|primary|reader|right|row|secondary|section|site|slot|sticky|tools|top|unit|user|view|"
    r"wrap|wrapper|zone")
#: Elements of this kind stay aside whatever they hold.
FIRM = {"nav", "footer", "aside", "dialog", "menu", "head", "button"}
#: Part of an element's words that the best region must hold to grow to the whole element.
GROW = 0.8
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*"
    r"(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))",
                   re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
#: Start weights, used for tags that the labelled pages lack.
WORD, TAG = 1.0, -3.0
LEAST, MOST = 0.1, 8.0


def _names_aside(name: str) -> bool:
    words = [w for w in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=\d)", name) if w]
    return any(map(HINT.fullmatch, words)) and all(
        HINT.fullmatch(w) or BESIDE.fullmatch(w) for w in words)


def _marked(name: str, attrs: str) -> bool:
    """Whether an element's name or attributes say that it lies around the main text."""
    if name in ASIDE:
        return True
    if not attrs or name in ("html", "body", "main", "article"):
        return False
    return bool(_HIDDEN.search(attrs)) or any(
        _names_aside(one) for a, b, c in _ATTR.findall(_CAMEL.sub("-", attrs).lower())
        for one in (a or b or c).split())


class Page:
    """A page as (tag, text) in order: a tag with "/" before a closing one, or "" and a text run.

    ``elements`` are (name, first, end, marked) in the order they open, end exclusive.
    ``aside`` tells for each token whether it lies in an element around the main text. The mark
    of an element is evidence that yields to what it holds: one around the article or main element
    with the most words is no aside, nor, on a page without such an element, is one around
    two thirds of the words. A header inside an article holds its heading. A closing tag ends everything opened since its opening tag; one
    without an opening tag ends nothing.
    """

    def __init__(self, html: str):
        self.tokens: list[tuple[str, str]] = []
        self.elements: list[list] = []
        stack: list[int] = []
        tokens, elements = self.tokens, self.elements

        def close(keep: int) -> None:
            for n in stack[keep:]:
                elements[n][2] = len(tokens)
            del stack[keep:]

        for m in _TOKEN.finditer(html):
            if m.lastgroup in ("text", "cdata"):
                tokens.append(("", m["text"] or m["cdata"] or ""))
            elif m["tag"]:
                name = m["tag"].lower()
                if m["close"]:
                    for i in range(len(stack) - 1, -1, -1):
                        own = elements[stack[i]][0]
                        if own == name:
                            close(i)
                            break
                        if name in INLINE and own in FRAMES:
                            break
                    tokens.append(("/" + name, ""))
                    continue
                if name in BLOCKS:  # a block ends a paragraph that was left open
                    while stack and (elements[stack[-1]][0] == "p" or elements[stack[-1]][0] in
                                     INLINE and any(elements[s][0] == "p" for s in stack)):
                        close(len(stack) - 1)
                tokens.append((name, ""))
                if name not in EMPTY and not m["attrs"].rstrip().endswith("/"):
                    stack.append(len(elements))
                    elements.append([name, len(tokens), None, _marked(name, m["attrs"])])
        close(0)
        self.words = [len(text.split()) for _, text in tokens]
        self.before = [0, *accumulate(self.words)]
        self._judge()

    def count(self, first: int, end: int) -> int:
        return self.before[end] - self.before[first]

    def _judge(self) -> None:
        mains = [e for e in self.elements if e[0] in ("article", "main")]
        chief = max(mains, key=lambda e: self.count(e[1], e[2]), default=None)
        steps = [0] * (len(self.tokens) + 1)
        for element in self.elements:
            name, first, end, marked = element
            if not marked:
                continue
            around = chief and first <= chief[1] and chief[2] <= end
            most = not chief and 3 * self.count(first, end) > 2 * self.before[-1]
            if name not in FIRM and (around or most):
                element[3] = False
            elif name == "header" and any(e[1] <= first and end <= e[2] for e in mains):
                element[3] = False
            else:
                steps[first] += 1
                steps[end] -= 1
        self.aside = [n > 0 for n in accumulate(steps[:-1])]
        self.kept = [0, *accumulate(0 if a else w for a, w in zip(self.aside, self.words,
                                                                  strict=True))]
        inside = [0] * (len(self.tokens) + 1)
        for _, first, end, _ in mains:
            inside[first] += 1
            inside[end] -= 1
        self.inside = [n > 0 for n in accumulate(inside[:-1])]


def fit_weights(pages: DataFrame, html_col: str = "html") -> dict[str, float]:
    """Weights of words ("") and tags, from the pages that label their main text with an article
    or main element. Counts cover all of them; one row per known tag comes to the driver."""
    def work(batches):
        counts: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for html in batch.column(0):
                page = Page(html.as_py() or "")
                if not any(page.inside):
                    continue
                for (tag, _), words, inside, aside in zip(
                        page.tokens, page.words, page.inside, page.aside, strict=True):
                    name = tag.lstrip("/")
                    key = (name if name in _KNOWN else "other", inside and not aside)
                    counts[key] = counts.get(key, 0) + (1 if tag else words)
        yield pa.RecordBatch.from_pydict({
            "tag": [k[0] for k in counts], "inside": [k[1] for k in counts],
            "n": list(counts.values())}, pa.schema([("tag", pa.string()), ("inside", pa.bool_()),
                                                    ("n", pa.int64())]))

    rows = pages.select(html_col).mapInArrow(work, "tag string, inside boolean, n long") \
        .groupBy("tag").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)),
                            F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n")))).collect()
    odds = {tag: log((a + 1) / (b + 1)) for tag, a, b in rows}
    word = odds.pop("", 0.0)
    weights = {tag: -min(MOST, max(LEAST, word - o)) for tag, o in odds.items()}
    return {"": min(MOST, max(WORD, word)), **weights}


#: Blocks that end an open paragraph.
BLOCKS = FRAMES - INLINE

_KNOWN = {"", *INLINE, *EMPTY, *FRAMES, *ASIDE, "h1", "h2", "h3", "h4", "h5", "h6", "tr", "th",
          "pre", "dl", "dt", "dd", "figure", "figcaption", "tbody", "thead", "center", "address"}


def scores(page: Page, weights: dict[str, float]) -> list[float]:
    """Words count for the region and tags against it; so do words around the main text."""
    word, other = weights.get("", WORD), weights.get("other", TAG)
    return [weights.get(tag.lstrip("/"), other) if tag else -word * n if aside else word * n
            for (tag, _), n, aside in zip(page.tokens, page.words, page.aside, strict=True)]


def best_region(values: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the greatest sum, by one scan; of equal sums the
    run that ends first, and (0, 0) where none is above 0."""
    here = best = 0.0
    start, found = 0, (0, 0)
    for i, value in enumerate(values):
        if here <= 0:
            here, start = 0.0, i
        here += value
        if here > best:
            best, found = here, (start, i + 1)
    return found


def grown(page: Page, first: int, end: int) -> tuple[int, int]:
    """The region with all that belongs to it: the least article or main element that holds at
    least half of its words is the region, lists, tables and last lines included. Otherwise the
    region grows to the least block around it whose words it holds but for a few."""
    kept = page.kept
    words = kept[end] - kept[first]
    held = [e for e in page.elements if e[0] in ("article", "main") and not page.aside[e[1] - 1]
            and 2 * (kept[max(first, min(end, e[2]))] - kept[min(end, max(first, e[1]))]) >= words]
    if words and held:
        return min(((e[1], e[2]) for e in held), key=lambda r: r[1] - r[0])
    around = [(e[1], e[2]) for e in page.elements if e[0] in FRAMES
              and e[1] <= first and end <= e[2] and words >= GROW * (kept[e[2]] - kept[e[1]])]
    return max(around, key=lambda r: (r[1] - r[0]), default=(first, end))


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """Text of the best region, without the elements in it that lie around the main text."""
    page = Page(html or "")
    first, end = grown(page, *best_region(scores(page, weights)))
    blocks: list[list[str]] = [[]]
    for (tag, text), aside in zip(page.tokens[first:end], page.aside[first:end], strict=True):
        name = tag.lstrip("/")
        if aside or tag and name not in INLINE:
            if blocks[-1]:
                blocks.append([])
        elif not tag:
            blocks[-1].append(text)
        elif name == "br":
            blocks[-1].append(" ")
    texts = (" ".join(unescape("".join(parts)).split()) for parts in blocks)
    return "\n".join(t for t in texts if t)


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id",
            url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars per page. Blocks are joined by one line feed.

    Without ``weights`` they are fitted on the pages first. A null or empty page, and one without
    words outside menus and the like, has the empty text. Ids and urls pass through unchanged,
    null or repeated; other columns are ignored.
    """
    weights = fit_weights(pages, html_col) if weights is None else weights

    def work(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).alias("url"), F.col(html_col)) \
        .mapInArrow(work, "page_id long, url string, text string, n_chars long")
