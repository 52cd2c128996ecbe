"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks of text at block-level tags. A block's two labels cost what a logistic classifier says of its text
(links, length, density around it, place in the page, what kind of element), and what its containers say: fixed log-odds for
elements that hold the article, elements of menus, footers and forms, class words, and hidden ones. The classifier sees nothing of the
containers; it is fitted to blocks whose containers tell what they are, of a bounded sample of ``sample`` pages, those
whose HTML hashes lowest. Both together are the capacities from the source and to the sink. Blocks that follow each other,
and blocks with the same parent, are tied by smoothness edges that grow weaker with their distance in the DOM. The minimum cut
labels the blocks.

A word of a class, id or role counts for its own element and what is in it, only at the end of a name ("site-footer") that does not
tell a state ("no-sidebar", "share-enabled"), and not where the element holds the page's article or body. A heading such as "3 Comments" says the same of what
follows it under its parent, and a block that begins as adverts do ("Sponsored", "Advertisement") of itself.

Defined cases: null and empty HTML give an empty text; a page without content blocks gives an empty text; scripts, styles,
text areas and comments that are never closed end with the page, and of other elements that are dropped with what
is in them, those never closed or closed in themselves lose their tag only; a head without end tag ends where its
content does; the text of math stays, without annotations; after a quote that is never closed, tags end at the next ">"; repeated
rows get the same text each; an empty table gives an empty result; other columns are not read. Pages are read in time that grows with their length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Elements dropped with what is in them: up to the end tag or the page's end, and only where there is an end tag.
RAW = "script style textarea".split()
DROPPED = "noscript template svg iframe object select canvas audio video annotation-xml annotation".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input br".split())
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd maction semantics none".split())
BOILERPLATE_TAGS = set("nav footer aside form menu dialog button fieldset".split())
CONTENT_TAGS = {"article", "main"}
#: Words of class, id and role that name what is not content, and what is.
BOILERPLATE_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social follow sidebar widget related recommended recommendations trending breadcrumb breadcrumbs menu "
    "nav navbar navigation footer masthead toolbar topbar comment comments disqus reply replies respond search pagination pager copyright legal disclaimer complementary contentinfo".split()
)
CONTENT_WORDS = set("article content post entry main story".split())
#: Opening one of these closes an open element of the kinds named.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
_TAG = r"<(/?)([a-zA-Z][\w:-]*)({})>"
TAG = re.compile(_TAG.format(r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*"))
#: Once a quote is found open at the page's end.
LENIENT = re.compile(_TAG.format("[^>]*"))
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Parts of a name that say that the page has, or lacks, what another part names.
STATES = set("has no with without is not show hide enable disable enabled disabled active open closed inside off on".split())
COMMENTS = re.compile(r"(?:\d+\s+)?(?:(?:reader|user)s?'?\s+)?(?:comments?|replies|responses|comentarios|kommentare|commentaires)(?:\s*\(?\d+\)?)?\s*:?|(?:leave|post|write) a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
ADVERT = re.compile(r"(?:advertisement|advertorial|sponsored|paid (?:content|partnership|post)|promoted|anzeige|werbung|publicidad|publicité)\b(?=\s*(?:[:.|–—-]|$)|\s+(?:content|post|by)\b)", re.I)

#: What the classifier sees of a block, and the centre of its weights' prior: what it says where no block teaches it.
FEATURES = ("bias", "link_share", "ln_words", "sentence", "heading", "paragraph", "list_item", "density", "edge")
PRIOR = np.array([-0.5, -3.0, 0.6, 0.5, 0.3, 0.7, -0.6, 0.2, -0.3])
#: Log-odds of being content that containers and labels add.
EVIDENCE = {"content": 2.5, "boilerplate": -6.0, "named": -7.0, "named_content": 0.5, "hidden": -8.0, "advert": -14.0}


class _Element:
    """An open element; ``block`` is the innermost one around it (or itself) that is not inline, ``up`` the one around that."""

    __slots__ = ("tag", "block", "up", "level", "marks", "holds_article")

    def __init__(self, tag: str, parent: "_Element | None", marks: frozenset):
        self.tag, self.marks, self.holds_article = tag, marks, False
        if parent is not None and tag in INLINE:
            self.block, self.up, self.level = parent.block, parent.up, parent.level
        else:
            self.block, self.up, self.level = self, parent and parent.block, parent.level + 1 if parent else 0


@dataclass
class Block:
    at: _Element
    named: tuple[_Element, ...]
    marks: frozenset
    text: str
    link_share: float
    heading: bool
    paragraph: bool
    list_item: bool
    noted: set[str] = field(default_factory=set)

    def evidence(self) -> set[str]:
        """Which of EVIDENCE hold for the block."""
        return self.noted | self.marks | ({"named"} if any(not e.holds_article for e in self.named) else set())


def _words(attributes: str) -> set[str]:
    """What an element's class, id and role name: the last two parts of each name."""
    found = set()
    for name in " ".join("".join(x) for x in NAMES.findall(attributes)).split():
        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        if parts and not STATES.intersection(parts):
            found.update(parts[-2:])
    return found


def _marks(tag: str, words: set[str], parent: frozenset, attributes: str) -> frozenset:
    found = set()
    if tag in CONTENT_TAGS:
        found.add("content")
    if tag in BOILERPLATE_TAGS or "content" not in parent | found and (tag == "header" or "header" in words):
        found.add("boilerplate")
    if words & CONTENT_WORDS:
        found.add("named_content")
    if attributes and HIDDEN.search(attributes):
        found.add("hidden")
    return parent | found if found - parent else parent


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag or text, attributes): text, opened and closed elements, without those that are dropped."""
    at, end, last, tag_of = 0, len(page), page.rfind(">"), TAG
    closing: dict[str, int] = {}  # where an element's last end tag is

    def closes(tag: str, start: int):
        pattern = re.compile(rf"</{tag}\s*>", re.I)
        if tag not in closing:
            closing[tag] = max((m.start() for m in pattern.finditer(page)), default=-1)
        return pattern.search(page, start) if closing[tag] >= start else None

    while at < end:
        if page[at] != "<":
            after = page.find("<", at)
            after = end if after < 0 else after
            yield "text", page[at:after], ""
            at = after
            continue
        if page.startswith("<!--", at):
            after = page.find("-->", at + 4)
            at = end if after < 0 else after + 3
            continue
        if at > last:
            yield "text", page[at:], ""
            return
        found = tag_of.match(page, at)
        if not found and tag_of is TAG and page[at + 1 : at + 3].lstrip("/")[:1].isalpha():
            tag_of = LENIENT
            found = tag_of.match(page, at)
        if not found:
            if page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.find(">", at) + 1
            else:
                yield "text", "<", ""
                at += 1
            continue
        shut, tag, attributes = found[1], found[2].lower(), found[3]
        at = found.end()
        if tag in RAW and not shut:
            close = closes(tag, at)
            at = close.end() if close else end
        elif tag in DROPPED:
            close = None if shut or attributes.endswith("/") else closes(tag, at)
            at = close.end() if close else at
        elif tag == "title" and not shut:
            close = closes(tag, at)
            after = page.find("<", at)
            at = close.end() if close else end if after < 0 else after
        elif tag not in RAW:
            yield "shut" if shut else "open", tag, attributes


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, with their places in the DOM and what is known of them."""
    root = _Element("", None, frozenset())
    stack, named, found, open_tags = [root], [], [], Counter()
    parts: list[str] = []
    linked, where = 0, None  # where: what was open when the block's text began

    def close() -> None:
        nonlocal parts, linked, where
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text and where:
            element, names, tags = where
            found.append(Block(element.block, names, element.marks, text, min(1.0, linked / len(text)), any(tags[h] for h in HEADINGS), tags["p"] > 0, tags["li"] > 0))
        parts, linked, where = [], 0, None

    def pop() -> None:
        element = stack.pop()
        open_tags[element.tag] -= 1
        if named and named[-1] is element:
            named.pop()

    for kind, tag, attributes in tokens(page or ""):
        if kind == "text":
            if where is None:
                if tag.isspace():
                    continue
                where = (stack[-1], tuple(named), {k: open_tags[k] for k in (*HEADINGS, "p", "li")})
            parts.append(tag)
            if open_tags["a"]:
                linked += len(tag)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if kind == "shut":
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if not inline:
            shut = CLOSES.get(tag, ()) + ("p", *HEADINGS)
            if any(open_tags[x] for x in shut):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shut:
                        while len(stack) > i:
                            pop()
                    elif stack[i].tag not in INLINE:
                        break
        if attributes.endswith("/"):
            continue
        words = _words(attributes) if "=" in attributes else set()
        element = _Element(tag, stack[-1], _marks(tag, words, stack[-1].marks, attributes))
        stack.append(element)
        open_tags[tag] += 1
        if words & BOILERPLATE_WORDS:
            named.append(element)
        if tag in CONTENT_TAGS or tag == "body":
            for e in named:
                e.holds_article = True
    close()
    return _noted(found)


def _noted(found: list[Block]) -> list[Block]:
    """Marks adverts by how they begin, and what follows a heading of comments under its parent, up to the next such heading."""
    under = None
    for b in found:
        if ADVERT.match(b.text):
            b.noted.add("advert")
        parent = b.at.up if b.at.tag in HEADINGS else None
        if parent is not None and COMMENTS.fullmatch(b.text):
            under = parent
        elif under is not None and parent is under:
            under = None
        if under is not None:
            e = b.at
            while e is not None and e.level > under.level:
                e = e.up
            if e is under:
                b.noted.add("named")
            else:
                under = None
    return found


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    ln_words = np.array([math.log1p(b.text.count(" ") + 1) for b in found])
    around = np.pad(ln_words, 1)
    place = np.abs(2 * np.arange(len(found)) / max(1, len(found) - 1) - 1)
    return np.column_stack([
        np.ones(len(found)), [b.link_share for b in found], ln_words, [b.text[-1] in ".!?…:;\"”)" for b in found], [b.heading for b in found], [b.paragraph for b in found],
        [b.list_item for b in found], (around[:-2] + around[2:]) / 2, place,
    ]).astype(float)


def minimum_cut(content: np.ndarray, boilerplate: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Whether each node stays on the source's side. A node costs boilerplate[i] there and content[i] on the other;
    an edge costs its weight when cut. Dinic's algorithm; only the difference of a node's costs needs an edge."""
    n = len(content)
    s, t, graph = n, n + 1, [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a].append([b, there, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, gain in enumerate((content - boilerplate).tolist()):
        join(s, i, gain, 0.0) if gain > 0 else join(i, t, -gain, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            a = queue.popleft()
            for b, room, _ in graph[a]:
                if room > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if t not in level:
            return np.array([i in level for i in range(n)], bool)
        at, path = [0] * (n + 2), []
        while True:
            a = path[-1][0] if path else s
            if a == t:
                flow = min(e[1] for e in path)
                for e in path:
                    e[1] -= flow
                    graph[e[0]][e[2]][1] += flow
                path = []
                continue
            while at[a] < len(graph[a]):
                e = graph[a][at[a]]
                if e[1] > 1e-9 and level.get(e[0]) == level[a] + 1:
                    path.append(e)
                    break
                at[a] += 1
            else:
                if not path:
                    break
                path.pop()
                at[path[-1][0] if path else s] += 1


def _distance(a: _Element, b: _Element) -> int:
    """How many steps up and down the DOM lie between two elements."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def main_text(page: str | None, weights: np.ndarray, smoothness: float = 1.5) -> str:
    found = blocks(page)
    if not found:
        return ""
    z = features(found) @ weights + [sum(EVIDENCE[k] for k in b.evidence()) for b in found]
    z = np.clip(z, -30, 30)
    edges, last_of = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, smoothness / (1 + _distance(found[i - 1].at, b.at))))
        parent = id(b.at.up)
        if last_of.get(parent, i - 1) < i - 1:
            edges.append((last_of[parent], i, smoothness / (2 + i - last_of[parent])))
        last_of[parent] = i
    # -ln P(boilerplate) is lost when a block is cut from the source, -ln P(content) when it stays
    keep = minimum_cut(np.logaddexp(0, z), np.logaddexp(0, -z), edges)
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels by their containers and features of the blocks whose containers tell."""
    for batch in batches:
        for page in batch.column(0).to_pylist():
            found = blocks(page)
            if not found:
                continue
            evidence = [b.evidence() for b in found]
            bad = np.array([bool(e & {"boilerplate", "named", "hidden", "advert"}) for e in evidence])
            told = bad | np.array(["content" in e for e in evidence])
            rows = np.column_stack([~bad, features(found)])[told].astype(float)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["row"])


def fit(pages: DataFrame, sample: int = 300, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of the logistic classifier: Newton steps on the sample's blocks, shrunk towards PRIOR."""
    chosen = pages.select("html").filter(F.col("html").isNotNull()).orderBy(F.xxhash64("html"), "html").limit(sample)
    rows = chosen.mapInArrow(_taught, "row array<double>").toPandas()["row"]
    w = PRIOR.copy()
    if not len(rows):
        return w
    data = np.stack(rows.to_numpy())
    y, x = data[:, 0], data[:, 1:]
    share = 500 / max(500, len(y))  # the prior keeps its weight however many blocks the sample's pages have
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = share * (x.T @ (p - y)) + ridge * (w - PRIOR)
        w = w - np.linalg.solve(share * (x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), gradient)
    return w


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(fit(pages) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, shared.value) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
