"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags with scores learned from the pages that mark
their article themselves (an ``article``, or ``main`` where there is none); the counts
are gathered from all of them. A word scores by its surroundings: the share of words in
its kind of block that are article text, less where it is a link, and at most minus one
in an element whose name, class, id or role stands for boilerplate. A tag scores minus
``TAG_COST`` times the share of tags of its name that stand outside. One linear scan
finds the contiguous region with the highest sum; it is widened to the smallest element
that holds it (an advert may part a short last paragraph from the rest), and its blocks
are the text, but for the elements in it that are boilerplate.

An element is boilerplate by its name (``BOILERPLATE``, as HTML defines them), or by a
whole class, id or role name whose words stand outside the article on labelled pages
(less than ``NOISE`` of them inside). Adverts and reader comments by name (``ALWAYS``)
are boilerplate in an article too. On pages that mark no article some usual names
(``USUAL``) count as seen outside ``PRIOR_WORDS`` times; in a marked article of other
names only what was learned drops anything. Parts of names mean nothing: ``social-history`` is not
``social``.

Time and memory are linear in the page: open elements are nodes of a tree, and a text
keeps one of them.

Defined cases: null and empty pages give an empty text; a page without any word that
scores gives an empty text; a very long or deeply nested page is read whole; unclosed
elements end with their parents; an unclosed script, style or comment runs to the end of
the page; repeated rows are read each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

TAG_COST = 3.25
#: Strength of the prior (half inside) that stands for unseen names.
PRIOR = 2.0
#: Share of a name's words inside articles below which it is boilerplate.
NOISE = 0.1
PRIOR_WORDS = 20

# Element names by their part in a page; whole class, id and role names of
# adverts and reader comments, and usual ones of other boilerplate.
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
BOILERPLATE = {"nav", "footer", "header", "aside", "form", "button", "select", "option", "dialog", "menu", "fieldset", "label", "head", "title"}
INLINE = {"a", "abbr", "b", "cite", "code", "em", "font", "i", "img", "input", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "br", "wbr", "meta", "link"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ALWAYS = {"ad", "ads", "advert", "advertisement", "sponsored", "comments", "comment-list", "reader-comments"}
USUAL = {"banner", "breadcrumb", "breadcrumbs", "comment", "complementary", "contentinfo", "cookie", "cookie-banner", "cookie-notice", "footer", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "search", "share", "sidebar", "social", "subscribe", "toolbar", "widget"}

NAMES = BLOCKS | BOILERPLATE | INLINE
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|noscript|textarea|iframe|svg|math|object|video|audio|canvas)\b[^>]*+>.*?(?:(</)\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
#: A tag that the end of the page cuts off.
BROKEN = re.compile(r"<[a-z/!?][^>]*+\Z", re.I)
MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
DIGITS = re.compile(r"[0-9]+")


class Node:
    """An open element; the page itself is the root."""

    __slots__ = ("block", "depth", "end", "inside", "link", "marks", "name", "noise", "parent", "start", "telling")

    def __init__(self, name: str, parent: Node | None, marks: tuple[str, ...], start: int):
        self.name, self.parent, self.marks, self.start, self.end = name, parent, marks, start, None
        self.depth = parent.depth + 1 if parent else 0
        self.inside = bool(parent and parent.inside)
        self.noise = bool(parent and parent.noise)
        self.link = name == "a" or bool(parent and parent.link)
        self.block = name if name in BLOCKS else parent.block if parent else "body"
        #: The names on the way here that may tell boilerplate; the same object as the parent's if none is new.
        self.telling = parent.telling if parent else None


class Item:
    """A tag (``words`` is None) or a run of text, in page order."""

    __slots__ = ("block", "feature", "node", "words")

    def __init__(self, feature: str, node: Node, block: int, words: str | None = None):
        self.feature, self.node, self.block, self.words = feature, node, block, words


def marks_of(attributes: str) -> tuple[str, ...]:
    """The class, id and role names of an element, numbers as one sign."""
    if "=" not in attributes:
        return ()
    names = [n for kind, *m in MARKS.findall(attributes) for n in ("".join(m).lower().split() if kind.lower() != "id" else ["".join(m).lower()])]
    return tuple(dict.fromkeys("m:" + DIGITS.sub("#", n) for n in names if n))


def items(page: str, noisy=lambda mark, inside: False) -> list[Item]:
    """Tags and texts of a page. noisy(mark, inside) tells whether a class, id or role name is boilerplate."""
    out: list[Item] = []
    mark = "article" if re.search(r"<article\b", page, re.I) else "main"
    root = top = Node("", None, (), 0)
    open_: Counter = Counter()
    block = number = at = 0
    end = page.rfind(">") + 1  # what follows holds no tag

    def text(s: str) -> None:
        words = html.unescape(s)
        if words:
            out.append(Item("", top, block, words if words.strip() else " "))

    def close() -> None:
        nonlocal top
        top.end = number
        open_[top.name] -= 1
        top = top.parent

    for m in TOKEN.finditer(page, 0, end):
        text(page[at : m.start()])
        at = m.end()
        if m[4] is None:
            if m[1]:
                out.append(Item("t:raw", top, block))
            if at == end and (m[1] and not m[2] or m[0].startswith("<!--") and not m[0].endswith("-->")):
                at = end = len(page)  # unclosed: the rest belongs to it
            continue
        name = m[4].lower()
        if name in BLOCKS or name in BOILERPLATE or name == "br":
            block += 1
            if name != "br":  # inline elements left open end with their block
                while top.name in INLINE:
                    close()
        if m[3]:
            if open_[name]:
                while top.name != name:
                    close()
                close()
        elif name not in VOID and not m[5].endswith("/"):
            if name in BLOCKS and top.name == "p" or name == "li" and top.name == "li":
                close()
            number += 1
            open_[name] += 1
            top = Node(name, top, marks_of(m[5]), number)
            top.inside |= name == mark
            if name in BOILERPLATE and not (name == "header" and top.inside):
                top.noise, top.telling = True, ("e:" + name, top.telling)
            if name not in ("html", "body", mark):
                for x in top.marks:
                    top.telling = (x, top.telling)
                    top.noise |= x[2:] in ALWAYS or noisy(x, top.inside)
        out.append(Item(f"t:{name if name in NAMES else 'other'}", top, block))
    text(BROKEN.sub("", page[at:]))
    while top is not root:
        close()
    root.end = number
    return out


def tally(pages) -> Counter:
    """(feature, inside) counts of the pages that mark their article: words by block, link and telling name, tags by name."""
    seen: Counter = Counter()
    for page in pages:
        own = items(page)
        if not any(x.node.inside and x.words is not None for x in own):
            continue
        by: Counter = Counter()
        chains: dict[int, tuple] = {}
        for x in own:
            inside = x.node.inside and not x.node.noise
            if x.words is None:
                seen[x.feature, inside] += 1
                continue
            n = len(x.words.split())
            if n:
                if not x.node.telling or inside:
                    seen["b:" + x.node.block, inside] += n
                if x.node.link:
                    seen["l:a", inside] += n
                if x.node.telling:
                    chains[id(x.node.telling)] = x.node.telling
                    by[id(x.node.telling), inside] += n
        # Words of each chain of names, added up from the innermost name outwards.
        depths: dict[int, int] = {}
        ready: dict[int, set] = {}
        for (k, inside), n in list(by.items()):
            ready.setdefault(length(chains[k], depths), set()).add((k, inside))
        for depth in range(max(ready, default=0), 0, -1):
            for k, inside in ready.pop(depth, ()):
                (name, outer), n = chains[k], by[k, inside]
                seen[name, inside] += n
                if outer is not None:
                    chains[id(outer)] = outer
                    by[id(outer), inside] += n
                    ready.setdefault(depth - 1, set()).add((id(outer), inside))
    return seen


def length(chain: tuple | None, known: dict[int, int]) -> int:
    """Names in a chain; those of its outer parts are kept in ``known``."""
    path = []
    while chain is not None and id(chain) not in known:
        path.append(chain)
        chain = chain[1]
    n = known[id(chain)] if chain is not None else 0
    for x in reversed(path):
        n += 1
        known[id(x)] = n
    return n


class Model:
    """Shares of words and tags inside articles, by feature."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.inside = {f: n for (f, i), n in counts.items() if i}
        self.outside = {f: n for (f, i), n in counts.items() if not i}

    def share(self, feature: str, more: int = 0) -> float:
        a, b = self.inside.get(feature, 0), self.outside.get(feature, 0) + more
        return (a + PRIOR / 2) / (a + b + PRIOR)

    def noisy(self, mark: str, inside: bool) -> bool:
        return self.share(mark, PRIOR_WORDS if mark[2:] in USUAL and not inside else 0) < NOISE

    def score(self, item: Item) -> float:
        if item.words is None:
            return -TAG_COST * (1 - self.share(item.feature))
        n = len(item.words.split())
        if not n:
            return 0.0
        if item.node.noise:
            return -float(n)
        word = self.share("b:" + item.node.block)
        return n * (word - (1 - self.share("l:a")) if item.node.link else word)


def region(scores: list[float]) -> tuple[int, int]:
    """[start, end) with the largest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, span, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, span = run, (start, i + 1)
    return span


def holder(a: Node, b: Node) -> Node:
    """The smallest element around both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def main_text(page: str, model: Model, scan=region) -> str:
    own = items(page, model.noisy)
    start, end = scan([model.score(x) for x in own])
    texts = [x for x in own[start:end] if x.words is not None and not x.node.noise and x.words.strip()]
    if not texts:
        return ""
    first, last = texts[0].block, texts[-1].block
    around = holder(min((x.node for x in texts), key=lambda n: n.start), max((x.node for x in texts), key=lambda n: n.start))
    while around.name in INLINE or around.name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
        around = around.parent
    whole = around.name not in ("", "html", "body")
    blocks: dict[int, list[str]] = {}
    for x in own:
        # A block that the region cuts is taken whole.
        if x.words is not None and not x.node.noise and (first <= x.block <= last or whole and around.start <= x.node.start <= around.end):
            blocks.setdefault(x.block, []).append(x.words)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def learn(pages: DataFrame) -> Model:
    """Counts of all labelled pages; names that fewer than two pages have stay out of the driver, as do all but the ``MOST`` commonest."""

    def count(batches):
        seen: Counter = Counter()
        for whole in batches:
            for batch in text_slices(whole, "html"):
                seen += tally(x or "" for x in batch.column("html").to_pylist())
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in seen]), pa.array([i for _, i in seen]), pa.array(list(seen.values()), pa.int64())], ["feature", "inside", "n"])

    rows = pages.select("html").mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    # Names of few words cannot be told from chance; the rest is bounded by MOST.
    rows = rows.where(f"NOT startswith(feature, 'm:') OR n >= {LEAST}").orderBy(F.col("n").desc(), "feature", "inside").limit(MOST)
    return Model({(r.feature, r.inside): r.n for r in rows.collect()})


#: Words from which a class, id or role name is learned, and the names learned at most (the commonest).
LEAST, MOST = 10, 100_000


def extract(pages: DataFrame) -> DataFrame:
    """Per page page_id, url, text and n_chars."""
    model = learn(pages)

    def run(batches):
        for whole in batches:
            for batch in text_slices(whole, "html"):
                texts = [main_text(x or "", model) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
