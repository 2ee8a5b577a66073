"""HTML extraction: a tree-structured graphical model over the page's elements, with exact marginals.

The page is parsed to its block elements and, as leaves, its runs of text between block boundaries. Every node has a
hidden label, article or not. A parent and a child share a potential (how often a child's label goes with its parent's,
for elements and for text), and each node has one for what is seen of it: tag, names in class and id, and for text its
length, share of linked words and punctuation. Potentials are smoothed counts over labelled pages (``html_pages``, made
from a seed; ``n_pages`` is the bound). Sum-product messages go from the leaves up and from the root down, which gives
every node's exact marginal; the text of leaves whose marginal is above one half is the main text.

Block text has its character references decoded, runs of white space made one space and is trimmed; blocks are joined by
a line feed in page order. A ``<br>`` counts as white space. Scripts, styles, head, forms' fields, buttons and comments in the markup hold no text.

Defined cases: a null or empty page, and one without article text, gives the empty text; unclosed, misnested and unknown
tags are tolerated, an open head ends at the first tag or text that cannot be in it, a tag cut off by the page's end is dropped; repeated rows are extracted each. An empty table gives
an empty result; other columns are not read. Parsing and messages take time in proportion to the page and no recursion,
so very long and very deep pages work. A map stage without any shuffle.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import record_batch, texts
from parley.llm.html_pages import training_pages

N_PAGES, SEED = 1200, 3
# Element kinds of HTML (fixed values)
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
 figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol p pre search section summary table
 tbody td tfoot th thead tr ul""".split())
HIDDEN = frozenset("""script style head title template noscript textarea select option button svg math iframe object canvas
 video audio datalist""".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
FOREIGN = frozenset("svg math".split())  # "/>" closes these and what is in them
HEAD_PARTS = frozenset("base link meta title style script noscript template noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("address article aside body details dialog div fieldset footer form header html main menu nav search section".split())
SCOPES = frozenset("table ul ol dl article section div main aside nav header footer body html td th form blockquote".split())
HARD_SCOPES = SCOPES - {"td", "th"}
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
SIGNS = re.compile("[>\"']")
#: A tag without angle brackets in its quotations: most are. It looks no further than the next bracket.
PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
MARK = re.compile(r'data-y="([01])"')
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Page:
    """Nodes in page order: element nodes and text leaves; a node's parent comes before it."""

    def __init__(self):
        self.parent: list[int] = []
        self.tag: list[str] = []       # "" for text
        self.attributes: list[str] = []
        self.text: list[str] = []
        self.linked: list[int] = []    # characters inside links, for text

    def add(self, parent: int, tag: str, attributes: str, text: str = "", linked: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


class Tags:
    """The tags of a page from left to right. Every sign that can end a tag or a quotation is looked at once, however many tags
    are cut off or have a stray quote."""

    def __init__(self, source: str):
        self.source, self.signs = source, None

    def _look(self) -> None:
        source = self.source
        self.signs = [m.start() for m in SIGNS.finditer(source)]
        self.after: dict[int, int] = {}  # by index of a sign outside quotations: where the tag ends, -1 for nowhere
        self.next_same = [len(self.signs)] * len(self.signs)
        seen: dict[str, int] = {}
        for k in range(len(self.signs) - 1, -1, -1):
            sign = source[self.signs[k]]
            self.next_same[k] = seen.get(sign, len(self.signs))
            seen[sign] = k

    def end(self, at: int) -> int:
        """The first ">" from ``at`` on that is outside quotations, -1 if there is none or a quotation does not end."""
        if self.signs is None:
            self._look()
        k, way, found = bisect_left(self.signs, at), [], -1
        while k < len(self.signs):
            if k in self.after:
                found = self.after[k]
                break
            way.append(k)
            if self.source[self.signs[k]] == ">":
                found = self.signs[k]
                break
            k = self.next_same[k] + 1  # beyond the quotation
        for k in way:
            self.after[k] = found
        return found

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(start, end, name, attributes, closing) of the next tag, comment or tag that is cut off; no name for the latter two."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            plain = PLAIN_TAG.match(source, start)
            if plain:
                closing, name, attributes = plain.groups()
                return start, plain.end(), name.lower(), attributes, closing != ""
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                return start, len(source) if stop < 0 else stop + 3, "", "", False
            sign = source[start + 1:start + 2]
            name = TAG_NAME.match(source, start + 1 + (sign == "/"))
            if name and (stop := self.end(name.end())) >= 0:
                return start, stop + 1, name.group().lower(), source[name.end():stop], sign == "/"
            if name or sign and sign in "!?/":
                stop = source.find(">", start)
                stop = len(source) if stop < 0 else stop + 1
                return start, stop if sign in "!?/" else self.cut(start + 1, stop), "", "", False
            at = start + 1
        return None

    def cut(self, at: int, stop: int) -> int:
        """Where a tag with a stray quote ends: at the next ">", or before the next tag or comment."""
        source = self.source
        while (at := source.find("<", at, stop)) >= 0:
            sign, name = source[at + 1:at + 2], TAG_NAME.match(source, at + 1)
            if sign and sign in "!?/" or name and self.end(name.end()) >= 0:
                return at
            at += 1
        return stop


NONE = (0,)


class Open(list):
    """The open elements, (tag, the block node each stands in), and where those of a tag and of a scope are."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.hard: list[int] = []

    def push(self, tag: str, node: int) -> None:
        at = len(self)
        self.append((tag, node))
        if at:  # the page itself is never closed
            self.places.setdefault(tag, []).append(at)
            if tag in SCOPES:
                self.scopes.append(at)
            if tag in HARD_SCOPES:
                self.hard.append(at)

    def shut(self) -> str:
        tag, _ = self.pop()
        self.places[tag].pop()
        for places in (self.scopes, self.hard):
            if places and places[-1] == len(self):
                places.pop()
        return tag

    def last(self, tags) -> int:
        """The innermost of the open elements with one of ``tags``, 0 if there is none."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def parse(source: str) -> Page:
    page = Page()
    page.add(-1, "html", "")
    stack, tags = Open(), Tags(source)
    stack.push("html", 0)
    run: list[str] = []
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        if run:
            raw = "".join(run)
            text = " ".join(html.unescape(raw).split())
            if text:
                page.add(stack[-1][1], "", "", text, min(linked, len(raw)))
            run.clear()
        linked = 0

    def see(raw: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and raw.strip():
            close(len(stack) - 1)
        if raw and not hidden:
            run.append(raw)
            if links:
                linked += len(raw)

    def close(at: int) -> None:
        """Close open elements down to ``at``."""
        nonlocal links, hidden
        if run and any(t in BLOCKS for t, _ in stack[at:]):
            flush()
        while len(stack) > at:
            t = stack.shut()
            links -= t == "a"
            hidden -= t in HIDDEN

    at, end = 0, len(source)
    while at < end:
        found = tags.next(at)
        if found is None:
            see(source[at:])
            break
        start, stop, tag, attributes, closing = found
        see(source[at:start])
        at = stop
        if not tag:
            continue
        if closing:
            i = stack.last(HEADINGS) if tag in HEADINGS else (stack.places.get(tag) or NONE)[-1]
            # an inline end tag does not reach out of its block
            if i and (tag in BLOCKS or not stack.scopes or stack.scopes[-1] <= i):
                close(i)
            continue
        if stack[-1][0] == "head" and tag not in HEAD_PARTS:  # the end tag of head may be left out
            close(len(stack) - 1)
        if tag == "br":
            see(" ")
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            flush()
            i = (stack.places.get("p") or NONE)[-1]  # an open paragraph ends before a block
            if i > (stack.scopes[-1] if stack.scopes else 0):
                close(i)
            ends = CLOSED_BY.get(tag)
            while ends and (i := stack.last(ends)) > (stack.hard[-1] if stack.hard else 0):
                close(i)
                if tag in ("li", "dt", "dd"):
                    break
        if attributes.endswith("/") and (tag in FOREIGN or tag in RAW and stack.last(FOREIGN)):
            continue
        if tag in VOID:
            if tag not in BLOCKS:
                see(" " if tag in ("img", "input") else "")
            continue
        if tag in BLOCKS and not hidden:
            stack.push(tag, page.add(stack[-1][1], tag, attributes))
        else:
            stack.push(tag, stack[-1][1])
        links += tag == "a"
        hidden += tag in HIDDEN
        if tag in RAW:  # its text is not markup
            stop = re.compile(f"</{re.escape(tag)}\\s*>|\\Z", re.I).search(source, at)
            at = stop.end()
            close(len(stack) - 1)
    flush()
    return page


def kind(tag: str) -> int:
    """Which transition leads to a node: to text, to a block of text, or to a section of the page."""
    return 0 if not tag else 2 if tag in SECTIONS else 1


def name_parts(attributes: str) -> list[str]:
    """Words in the names of class, id and role."""
    if "=" not in attributes:
        return []
    found = (a or b or c for a, b, c in NAMES.findall(attributes))
    return [p.lower() for names in found for p in NAME_PART.findall(names)]


def link_share(linked: int, size: int) -> int:
    share = linked / max(1, size)
    return 0 if share < 0.1 else 1 if share < 0.5 else 2


def features(page: Page) -> Iterator[tuple[str, ...]]:
    """What is seen of each node in turn."""
    size, linked = [len(t) for t in page.text], list(page.linked)
    for i in range(len(size) - 1, 0, -1):  # an element's text is all that is under it
        size[page.parent[i]] += size[i]
        linked[page.parent[i]] += linked[i]
    for i, tag in enumerate(page.tag):
        links = link_share(linked[i], size[i])
        if tag:
            names = dict.fromkeys(name_parts(page.attributes[i]))
            up, how = page.tag[page.parent[i]] if i else "", f"{links}{'named' if names else 'bare'}"
            yield (f"<{tag}<{up}{how}", f"<{tag}{how}", *("." + p for p in names))
        else:
            text = page.text[i]
            n = text.count(" ") + 1
            yield (f"words{min(n.bit_length(), 6)}", f"links{links}", "stop" if text[-1] in ".!?:\"'”»…" else "open",
                   "sign" if text[0] in "©|»•" else "plain")


class TreeModel:
    """Potentials of a two-label tree: log-odds of what a node shows, and label transitions by kind of child."""

    def __init__(self, shown: dict[str, float], edge: list[list[list[float]]], root: float):
        self.shown, self.edge, self.root = shown, edge, root

    @classmethod
    def trained(cls, pages: list[str]) -> "TreeModel":
        counts: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        nodes = {True: [0.0, 0.0], False: [0.0, 0.0]}
        edges = [[[1.0, 1.0], [1.0, 1.0]] for _ in range(3)]
        roots = [1.0, 1.0]
        for source in pages:
            page = parse(source)
            labels = marked_labels(page)
            for i, (y, seen) in enumerate(zip(labels, features(page))):
                leaf = not page.tag[i]
                nodes[leaf][y] += 1
                for f in seen:
                    counts[f][y] += 1
                if i:
                    edges[kind(page.tag[i])][labels[page.parent[i]]][y] += 1
                else:
                    roots[y] += 1
        shown = {}
        for f, (no, yes) in counts.items():
            leaf = f[0] not in "<."
            shown[f] = math.log((yes + 0.5) / (nodes[leaf][1] + 1)) - math.log((no + 0.5) / (nodes[leaf][0] + 1))
        edge = [[[no / (no + yes), yes / (no + yes)] for no, yes in rows] for rows in edges]
        return cls(shown, edge, roots[1] / sum(roots))

    def evidence(self, seen: tuple[str, ...]) -> Iterator[float]:
        """Log-odds of what a node shows; an element's tag counts with its parent's tag or, where that is new, alone."""
        if seen[0][0] == "<" and seen[0] in self.shown:
            seen = (seen[0], *seen[2:])
        return (self.shown.get(f, 0.0) for f in seen)

    def marginals(self, page: Page) -> list[float]:
        """P(article) of every node: messages up from the leaves, then down from the root."""
        n = len(page.parent)
        odds = [math.exp(max(-30.0, min(30.0, sum(self.evidence(seen))))) for seen in features(page)]
        # below[i]: evidence for label 0 and 1 from node i and all under it, scaled to sum 1
        below0, below1 = [1.0] * n, odds
        up0, up1 = [0.0] * n, [0.0] * n  # the message of i to its parent
        for i in range(n - 1, -1, -1):
            total = below0[i] + below1[i]
            b0, b1 = below0[i] / total, below1[i] / total
            below0[i], below1[i] = b0, b1
            if i:
                (s00, s01), (s10, s11) = self.edge[kind(page.tag[i])]
                m0, m1 = s00 * b0 + s01 * b1, s10 * b0 + s11 * b1
                up0[i], up1[i] = m0, m1
                p = page.parent[i]
                a0, a1 = below0[p] * m0, below1[p] * m1
                if a0 + a1 < 1e-200:
                    a0, a1 = a0 * 1e200, a1 * 1e200
                below0[p], below1[p] = a0, a1
        out = [0.0] * n
        total = below0[0] * (1 - self.root) + below1[0] * self.root
        out[0] = below1[0] * self.root / total
        for i in range(1, n):
            p = page.parent[i]
            # the parent's belief without what came from this child
            c0, c1 = (1 - out[p]) / up0[i], out[p] / up1[i]
            (s00, s01), (s10, s11) = self.edge[kind(page.tag[i])]
            a0, a1 = (c0 * s00 + c1 * s10) * below0[i], (c0 * s01 + c1 * s11) * below1[i]
            out[i] = a1 / (a0 + a1)
        return out

    def main_text(self, source: str) -> str:
        page = parse(source)
        return "\n".join(t for t, tag, p in zip(page.text, page.tag, self.marginals(page)) if not tag and p > 0.5)


def marked_labels(page: Page) -> list[int]:
    """Labels of a training page: text by the nearest mark above it, an element by most of its text."""
    n = len(page.parent)
    near, yes, every = [0] * n, [0] * n, [0] * n
    for i in range(n):
        m = MARK.search(page.attributes[i])
        near[i] = int(m.group(1)) if m else near[page.parent[i]] if i else 0
        if not page.tag[i]:
            every[i] = len(page.text[i])
            yes[i] = near[i] * every[i]
    for i in range(n - 1, 0, -1):
        yes[page.parent[i]] += yes[i]
        every[page.parent[i]] += every[i]
    return [int(2 * y > e) if e else k for y, e, k in zip(yes, every, near)]


@cache
def trained_model(n_pages: int = N_PAGES, seed: int = SEED) -> TreeModel:
    return TreeModel.trained(training_pages(n_pages, seed))


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               n_pages: int = N_PAGES, seed: int = SEED) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. The model, a small table, goes to the tasks with the plan."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    trained = trained_model(n_pages, seed)
    parts = (trained.shown, trained.edge, trained.root)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, schema = TreeModel(*parts), None
        for b in batches:
            schema = schema or pa.schema([("page_id", b.schema.field(0).type), ("url", pa.string()), ("text", pa.string()),
                                          ("n_chars", pa.int64())])
            found = [model.main_text(t) for t in texts(b.column(2))]
            yield record_batch(schema, b.column(0), b.column(1).cast(pa.string()), found, [len(t) for t in found])

    return src.mapInArrow(extract, f"page_id {src.schema['page_id'].dataType.simpleString()}, url string, text string, "
                          "n_chars bigint")
