"""HTML extraction by the maximum-scoring subsequence.

A page is read as a sequence of words and tags. Words score positive by the
element they stand in, tags negative, with weights counted on labelled pages
(how often an element's words, or a tag, occur inside and outside of the main
text). One linear scan finds the contiguous region of the highest sum; its
blocks, without what is boilerplate by element or class, are the main text.
A class marks boilerplate only if the whole of it says so, and not where its
element holds nearly all of the page's words.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statgate.llm.common import kept_names

LABELLED_PAGES, LABELLED_CHARS = 2000, 1 << 16  # pages that weights are counted on, at most, and their length

#: HTML elements by their role.
RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
TEXT = {*INLINE, "p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt"}
BOILERPLATE = {
    "head", "title", "nav", "menu", "header", "footer", "aside", "button", "select", "option", "svg", "canvas", "audio", "video", *RAW,
}
#: Boilerplate too, unless the page's prose stands inside, as where one form is put around the whole page.
WRAPPING = {"form", "fieldset", "dialog", "object"}
#: Elements whose words are prose.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd"}
#: Elements that text is laid out in; where no labelled page has them, they weigh as little as those of text.
LAYOUT = {
    "table", "caption", "colgroup", "col", "thead", "tbody", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "hr", "figure", "figcaption", "picture",
    "source", "details", "summary", "hgroup",
}
#: Words of a class or id that mark boilerplate.
BOILERPLATE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "replies", "share", "sharing", "sidebar",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that say only where or in which form such an element stands.
BOILERPLATE_PARTS = {
    "area", "bar", "block", "bottom", "box", "buttons", "container", "content", "form", "global", "inner", "item", "items", "left", "links", "list", "main",
    "page", "post", "posts", "primary", "right", "secondary", "section", "site", "top", "wrap", "wrapper",
}
#: Of these names, those that can outweigh a short text; they are believed unless they hold all words.
LONG_NAMES = {
    "breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "disqus", "footer", "menu", "nav", "navbar", "navigation", "pagination", "replies",
    "sidebar", "toolbar",
}
#: Of the words outside of boilerplate elements, an element marked by another name that holds this share is the page's wrapper.
WRAPPER_SHARE = 0.9
#: An element that starts here ends an open paragraph.
CLOSES_P = {
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "th", "thead", "tr", "ul",
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*(?:>|\Z)", re.S
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

DRAWS = 1 << 30
WORD, TAG = 0, 1
Item = tuple[int, str, str, bool]  # kind, key, text of a run of words, whether it is or lies in boilerplate

#: Weights of keys that no labelled page has.
DEFAULT_WORD, DEFAULT_TAG, DEFAULT_TEXT_TAG = 1.0, -1.0, -0.1


def _mark(token: str) -> float:
    """The share of the page's words up to which a class, id or role marks boilerplate; 0 if not all its words say so.

    'sidebar' and 'site-footer' do, 'no-sidebar' does not.
    """
    parts = {part.lower() for part in SPLIT.split(token) if part}
    if parts.isdisjoint(BOILERPLATE_NAMES) or not parts <= BOILERPLATE_NAMES | BOILERPLATE_PARTS:
        return 0.0
    return WRAPPER_SHARE if parts.isdisjoint(LONG_NAMES) else 1.0


def _marked(name: str, attributes: str) -> float:
    if name in ("html", "body", "article", "main") or not attributes:
        return 0.0
    found = (next(filter(None, m), "") for m in NAMES.findall(attributes))
    return max((_mark(token) for value in found for token in value.split()), default=0.0)


class Elements:
    """The elements of a page in order, parents first; number 0 is the page itself."""

    def __init__(self):
        self.parent, self.main, self.marked, self.words, self.prose = [0], [False], [0.0], [0], [0]
        self.fixed = [False]  # boilerplate by element, its own or an ancestor's
        self.wrapping = [False]

    def add(self, parent: int, name: str, attributes: str) -> int:
        self.parent.append(parent)
        self.fixed.append(self.fixed[parent] or name in BOILERPLATE)
        self.main.append(name in ("article", "main"))
        self.marked.append(_marked(name, attributes))
        self.wrapping.append(name in WRAPPING)
        self.words.append(0)
        self.prose.append(0)
        return len(self.parent) - 1

    def _within(self, own: list[int]) -> list[int]:
        """Per element, the words of it and all it holds, without those of boilerplate elements."""
        words = [0 if fixed else n for n, fixed in zip(own, self.fixed, strict=True)]
        for i in range(len(words) - 1, 0, -1):
            words[self.parent[i]] += words[i]
        return words

    def boilerplate(self) -> list[bool]:
        """Per element, whether it is boilerplate, itself or by an ancestor.

        A mark does not hold for an element with nearly all words of the page,
        nor is a form boilerplate that has nearly all of its prose. Where all
        <article> and <main> lie in marked elements, they end the mark.
        """
        if not any(self.marked) and not any(self.wrapping):
            return self.fixed
        words, prose = self._within(self.words), self._within(self.prose)
        marked = [m > 0 and (n == 0 or n < m * words[0]) for m, n in zip(self.marked, words, strict=True)]
        for i, wrapping in enumerate(self.wrapping):
            if wrapping and (prose[i] == 0 or prose[i] < WRAPPER_SHARE * prose[0]):
                marked[i] = True

        def spread(ended: bool) -> list[bool]:
            out = [False]
            for i in range(1, len(marked)):
                out.append(self.fixed[i] or marked[i] or out[self.parent[i]] and not (ended and self.main[i]))
            return out

        out = spread(False)
        found = [i for i, main in enumerate(self.main) if main]
        return spread(True) if found and all(out[i] for i in found) else out


def items(page: str) -> Iterator[Item]:
    """Words (in runs) and tags of a page, in order. Comments, scripts and styles are left out."""
    elements = Elements()
    found = list(_items(page, elements))
    boilerplate = elements.boilerplate()
    return ((kind, key, text, boilerplate[number]) for kind, key, text, number in found)


def _items(page: str, elements: Elements) -> Iterator[tuple[int, str, str, int]]:
    """The items with the number of the element that each belongs to."""
    # Open elements; their number; the nearest one that is not inline, itself or an ancestor.
    stack: list[tuple[str, int, str]] = []
    opened: Counter = Counter()  # how many of each name are in the stack, so that no tag walks all of it in vain
    at = 0

    def words(text: str) -> tuple[int, str, str, int]:
        number, key = stack[-1][1:] if stack else (0, "")
        n = len(text.split())
        elements.words[number] += n
        elements.prose[number] += n * (key in PROSE)
        return WORD, key, text, number

    while (m := TOKEN.search(page, at)) is not None:
        if m.start() > at:
            yield words(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        closing, name, attributes = m[1] == "/", m[2].lower(), m[3]
        if closing:
            yield TAG, "/" + name, "", stack[-1][1] if stack else 0
            while opened[name]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == name:
                    break
            continue
        if name in CLOSES_P and stack and stack[-1][2] == "p":  # nothing but inline elements since the paragraph
            while opened["p"]:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == "p":
                    break
        number = elements.add(stack[-1][1] if stack else 0, name, attributes)
        yield TAG, name, "", number
        if name in VOID or attributes.rstrip().endswith("/") and name in ("path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((name, number, name if name not in INLINE else stack[-1][2] if stack else ""))
        opened[name] += 1
    if at < len(page):
        yield words(page[at:])


def count(page: str, main: str = "article") -> tuple[Counter, Counter]:
    """Keys inside and outside of the page's ``main`` element, which labels its main text; none if it hasn't exactly one.

    What is boilerplate by element or class is not counted: the links of a
    menu say nothing about links in running text.
    """
    inside, outside = Counter(), Counter()
    if len(re.findall(rf"<{main}\b", page, re.I)) != 1:
        return inside, outside
    into = outside
    for kind, key, text, boilerplate in items(page):
        if kind == TAG and key == f"/{main}":
            into = outside
        if not boilerplate:
            into[f"<{key}" if kind == TAG else key] += 1 if kind == TAG else len(text.split())
        if kind == TAG and key == main:
            into = inside
    return inside, outside


def weights(inside: Counter, outside: Counter) -> dict[str, float]:
    """Log odds of each key, positive up to 3 for words and negative from -0.1 to -8 for tags."""
    out = {}
    for key in {*inside, *outside}:
        odds = math.log((inside[key] + 1) / (outside[key] + 1))
        out[key] = -min(8.0, max(0.1, 0.1 - odds)) if key.startswith("<") else min(3.0, max(0.0, odds))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from about ``most`` pages that carry one <article>, drawn by a hash; the defaults apply where there is none.

    Each page is drawn on its own, with probability ``most`` over the number
    of such pages, so nothing is sorted or gathered. Pages of over
    ``LABELLED_CHARS`` characters are not counted on.
    """
    labelled = pages.where((F.length(html_col) <= LABELLED_CHARS) & F.contains(F.lower(html_col), F.lit("<article")))
    share = min(DRAWS, -(-most * DRAWS // max(1, labelled.count())))
    drawn = F.pmod(F.xxhash64(F.col(id_col), F.monotonically_increasing_id()), F.lit(DRAWS)) < share
    sample = labelled.withColumn("_drawn", drawn).where("_drawn")

    def run(batches):
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                a, b = count(page.as_py() or "")
                inside.update(a)
                outside.update(b)
        keys = [*{*inside, *outside}]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())],
            names=["key", "inside", "outside"],
        )

    counted = sample.select(html_col).mapInArrow(run, "key string, inside long, outside long")
    rows = counted.groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights(Counter({r["key"]: r["inside"] for r in rows}), Counter({r["key"]: r["outside"] for r in rows}))


def _unseen(tag: str) -> float:
    """The weight of a tag that no labelled page has, by its kind."""
    return DEFAULT_TEXT_TAG if tag.lstrip("/") in TEXT | LAYOUT else DEFAULT_TAG


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the highest positive sum, the first of equals; (0, 0) if no score is positive."""
    best, region, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += score
        if sum_ > best:
            best, region = sum_, (start, i + 1)
    return region


def main_text(page: str | None, weight: dict[str, float]) -> str:
    """The main text: blocks joined by line ends, references decoded, white space within a block as single spaces."""
    sequence = list(items(page or ""))
    # what is boilerplate counts for nothing, so neither a menu nor a block of adverts amid the text parts it
    scores = [
        0.0 if boilerplate else len(text.split()) * weight.get(key, DEFAULT_WORD) if kind == WORD else weight.get(f"<{key}", _unseen(key))
        for kind, key, text, boilerplate in sequence
    ]
    start, end = best_region(scores)
    blocks, block = [], []
    for kind, key, text, boilerplate in sequence[start:end]:
        if kind == TAG:
            if key.lstrip("/") not in INLINE and block:
                blocks.append("".join(block))
                block = []
        elif not boilerplate:
            block.append(text)
    blocks.append("".join(block))
    lines = (" ".join(html.unescape(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def extract(
    pages: DataFrame, weight: dict[str, float], html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), text_col: str = "text"
) -> DataFrame:
    """Per row of ``pages``: the columns ``keep`` and the main text of the whole page.

    Null or empty html, and pages without words, give an empty text. Repeated
    rows are extracted each; an empty table gives an empty result. A long page
    is read whole, in time linear in its length. A kept column named like the
    text gets underscores before it.
    """
    names = kept_names(keep, [text_col])
    rows = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.col(f"`{html_col}`").cast("string"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(text_col, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(page.as_py(), weight) for page in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)
