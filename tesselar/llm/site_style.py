"""Main-text extraction with site style trees.

The DOMs of a host's pages are merged into one style tree.  An element node is known by its parent's style and its place
in it; the style of an element on a page is the sequence of its children (block elements with their classes, and text).
So elements of pages of one layout meet in a node, and where pages differ, each style has its own nodes below.

Importance.  An element node of m pages has the presentation importance -sum p log_m p over its styles; a text node has
the content importance 1 - the mean over its texts of log_m(pages with the text).  Both are 1 where m is 1, and lean
towards 1 for few pages: repetition over m pages counts (1 - 1/m)^2.  Importances are composed from the leaves up,
as the page has them: (1 - g^l) of the node's own and g^l of the mean of its children, l being the number of styles
and g 0.9.  Priors then scale a branch: by what its tag, role, class or id say of it (menu, header, footer, sidebar,
notice, advert, form, comments), up inside an article or main element, and down outside of one, by the share of the
page's text that the article holds.  A branch goes if neither its top nor any node below reaches MIN_IMPORTANCE.

Scale: two passes over the pages, each in place.  Only hashes (node, style or text) are aggregated, with map-side
combining; a host's nodes of low importance reach its pages once a task: those of hosts with over 1/1000 of the pages are
broadcast and joined to the host's first page in a task, the others are dealt by host with their pages, ahead of them.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.llm.common import HOT_SHARE, slices, stored

MIN_IMPORTANCE = 0.3
#: The weight of what children say against the number of styles of their parent.
DECAY = 0.9
#: What a branch marked as boilerplate keeps of its importance, and what text in an article has at least.
MARKED, INSIDE = 0.2, 0.25
#: Nodes of this importance or more are taken as important throughout.
CERTAIN = 0.95

# Elements by their role in a page.
BLOCKS = frozenset(
    """html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption
    blockquote pre figure figcaption address hr nav header footer aside form fieldset details summary center hgroup
    dialog menu noscript search legend option select textarea button iframe object template title head""".split()
)
BOILERPLATE = frozenset("head title nav header footer aside form fieldset noscript template iframe object dialog menu search select textarea button svg canvas audio video map datalist".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MARKS = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead banner cookie cookies consent
    gdpr notice notices alert popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored promo
    promotion comment comments commentlist respond reply replies disqus share sharing social related recommended
    newsletter subscribe subscription signup login widget widgets pagination pager toolbar skip""".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def _marked(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element starts a branch of no importance; inside: it is within an article or main element."""
    if tag in BOILERPLATE:
        return not (tag == "header" and inside)
    if not attributes:
        return False
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "").lower()):
        return True
    names = {x.lower() for x in _PARTS.split(attributes.get("class", "") + " " + attributes.get("id", ""))}
    if tag in ("html", "body", "main", "article"):
        return tag == "article" and bool(names & {"comment", "comments", "reply"})
    return bool(names & MARKS)


@dataclass
class Element:
    """An element of a page: label is its tag with its classes, children are elements and texts in order.

    inside: it is or lies in an article or main element; around: such an element lies in it.
    """

    label: str
    marked: bool = False
    inside: bool = False
    around: bool = False
    children: list[Element | str] = field(default_factory=list)


def dom(page: str) -> Element:
    """The tree of a page's block elements; inline elements are part of their block's text, empty elements have no node."""
    top = Element("")
    stack, tags = [top], [""]
    text: list[str] = []

    def flush() -> None:
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        if joined:
            stack[-1].children.append(joined)
        text.clear()

    def close(depth: int) -> None:
        flush()
        while len(stack) > depth:
            tags.pop()
            if not stack.pop().children:
                stack[-1].children.pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text.append(page[at : m.start()] if m else page[at:])
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        block = tag in BLOCKS or tag in BOILERPLATE
        if m[1]:
            if block:
                depth = next((k for k in range(len(tags) - 1, 0, -1) if tags[k] == tag), len(tags))
                close(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = end.start() if end else n
            continue
        if tag == "br":
            text.append(" ")
        if tag in EMPTY and tag != "hr" or not block:
            continue
        flush()
        if tag == "hr":
            continue
        ends = CLOSED_BY.get(tag, set()) | {"p"}
        while tags[-1] in ends:
            close(len(tags) - 1)
        attributes = _attributes(m[3])
        inside = stack[-1].inside or tag in ("article", "main")
        label = tag + "".join("." + c for c in sorted(attributes.get("class", "").split()))
        new = Element(label, _marked(tag, attributes, inside), inside)
        if inside and not stack[-1].inside:
            for e in stack:
                e.around = True
        stack[-1].children.append(new)
        stack.append(new)
        tags.append(tag)
    close(1)
    return top


def key(*parts: object) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode("utf-8", "replace")) - (1 << 63)


def style_nodes(element: Element, node: int = 0) -> Iterator[tuple[int, int, bool]]:
    """(style node, its style or text, whether a text) of an element and all below, in order."""
    todo: list[tuple[int, Element | str]] = [(node, element)]
    while todo:
        node, e = todo.pop()
        if isinstance(e, str):
            yield node, key(e), True
            continue
        style = key(node, ["" if isinstance(c, str) else c.label for c in e.children])
        yield node, style, False
        todo += [(key(style, k), c) for k, c in reversed(list(enumerate(e.children)))]


class Known:
    """(importance, number of styles) by style node, in sorted arrays: a host may have many nodes."""

    def __init__(self, low: pa.StructArray) -> None:
        """low: node, importance, styles."""
        nodes, values, styles = (low.field(k).to_numpy() for k in range(3))
        order = nodes.argsort()
        self.nodes, self.values, self.styles = (array(t, c[order].astype(t).tobytes()) for t, c in zip("qdq", (nodes, values, styles)))

    def get(self, node: int, default: tuple[float, int]) -> tuple[float, int]:
        i = bisect_left(self.nodes, node)
        return (self.values[i], self.styles[i]) if i < len(self.nodes) and self.nodes[i] == node else default


def main_text(page: Element, importance: dict[int, tuple[float, int]] | Known) -> list[str]:
    """The texts of the branches that stay; importance: (importance, number of styles) of style nodes, others being 1 and alone."""
    flat: list[tuple[Element | str, int, float, bool]] = []  # in page order: node, place of its parent, prior, inside
    todo: list[tuple[Element | str, int, float, bool]] = [(page, -1, 1.0, False)]
    while todo:
        e, parent, prior, inside = todo.pop()
        if isinstance(e, Element):
            prior, inside = prior * (MARKED if e.marked else 1), e.inside
            todo += [(c, len(flat), prior, inside) for c in reversed(e.children)]
        flat.append((e, parent, prior, inside))
    sizes = [sum(len(e) for e, _, prior, inside in flat if isinstance(e, str) and prior == 1 and inside >= least) for least in (False, True)]
    outside = 1 - sizes[1] / sizes[0] if sizes[0] else 1.0
    below, greatest = [0.0] * len(flat), [0.0] * len(flat)
    for i, (node, _, _) in reversed(list(enumerate(style_nodes(page)))):
        e, parent, prior, inside = flat[i]
        value, styles = importance.get(node, (1.0, 1))
        if isinstance(e, Element):
            share = DECAY**styles
            value = (1 - share) * value + share * below[i] / max(1, len(e.children))
        around = isinstance(e, Element) and e.around
        shown = prior * (INSIDE + (1 - INSIDE) * value if inside else value if around else value * outside)
        greatest[i] = max(greatest[i], shown)
        if parent >= 0:
            below[parent] += value
            greatest[parent] = max(greatest[parent], greatest[i])
    stays: list[bool] = []
    for (_, parent, _, _), most in zip(flat, greatest):
        stays.append((parent < 0 or stays[parent]) and most >= MIN_IMPORTANCE)
    return [e for (e, *_), kept in zip(flat, stays) if kept and isinstance(e, str)]


def _host(url: object) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))


def importances(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, node, m, styles, text, importance) of every style node: m different pages have it, in so many styles or texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows: list[tuple] = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(style_nodes(dom(page or "")))
                copy = key(found)  # pages of the same tree and texts count once
                rows += [(host, node, value, text, copy) for node, value, text in found]
            types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["host", "node", "value", "text", "copy"])

    rows = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = rows.mapInArrow(run, "host string, node long, value long, text boolean, copy long").distinct()
    values = found.groupBy("host", "node", "text", "value").agg(F.count("*").alias("k"))
    nodes = values.groupBy("host", "node", "text").agg(
        F.sum("k").alias("m"), F.count("*").alias("styles"), F.avg(F.ln("k")).alias("mean_ln"), F.sum(F.col("k") * F.ln("k")).alias("sum_ln")
    )
    # the entropy of the styles is ln m - sum(k ln k) / m; evenness: how much of the node is repetition, 0 to 1
    evenness = F.when(F.col("text"), F.col("mean_ln")).otherwise(F.col("sum_ln") / F.col("m")) / F.ln("m")
    sure = F.pow(1 - 1 / F.col("m"), F.lit(2))
    return nodes.select("host", "node", "m", "styles", "text", F.when(F.col("m") > 1, 1 - evenness * sure).otherwise(1.0).alias("importance"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text (blocks joined by newlines, empty if none), n_chars.

    A null page is empty; null URLs share the empty host; repeated rows are alike; an empty table gives no rows;
    other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), _host(F.col(url_col)).alias("host"))
    nodes = importances(pages, url_col, html_col).where(F.col("importance") < CERTAIN)
    low = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "importance", "styles")).alias("low"))  # nodes that pages of the host repeat
    per_host = rows.groupBy("host").agg(F.count("*").alias("n")).join(low, "host", "left")
    per_host = stored(per_host, "style-nodes")
    total = per_host.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def told_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in slices(batches):
            hosts = b.column(2).to_pylist()
            first = [None if h in seen or seen.add(h) else h for h in hosts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first, pa.string())], [*b.schema.names, "first"])

    def extracted(sorted_: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[str, Known | dict] = {}
            for b in slices(batches):
                out = []
                lows = b.column(4)
                for i, (id_, url, host, page, told) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 3, 5)))):
                    if told:
                        if sorted_:
                            known.clear()  # the host before has ended
                        known[host] = Known(lows[i].values) if lows[i].is_valid else {}
                        if sorted_:
                            continue  # this row is no page
                    text = "\n".join(main_text(dom(page or ""), known[host]))
                    out.append((id_, url, text, len(text)))
                cols = zip(*out) if out else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["id", "url", "text", "n_chars"])

        return run

    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot, names = per_host.where(is_hot), F.broadcast(per_host.where(is_hot).select("host"))
    near = rows.join(names, "host").select("id", "url", "host", "html").mapInArrow(told_once, "id long, url string, host string, html string, first string")
    near = near.join(F.broadcast(hot.select(F.col("host").alias("first"), "low")), "first", "left")  # keeps the order of a task's rows
    near = near.select("id", "url", "host", "html", "low", F.col("first").isNotNull().alias("told"))
    far = rows.join(names, "host", "left_anti").select("id", "url", "host", "html", F.lit(None).cast(per_host.schema["low"].dataType).alias("low"), F.lit(False).alias("told"))
    nothing = lambda t, c: F.lit(None).cast(t).alias(c)
    far = far.unionByName(per_host.where(~is_hot).select(nothing("long", "id"), nothing("string", "url"), "host", nothing("string", "html"), "low", F.lit(True).alias("told")))
    far = far.repartition("host").sortWithinPartitions("host", F.desc("told"))
    schema = "id long, url string, text string, n_chars long"
    out = near.mapInArrow(extracted(False), schema).unionByName(far.mapInArrow(extracted(True), schema))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
