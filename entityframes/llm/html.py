"""Main text of web pages by wrapper induction.

1. Pages of a host are grouped by *structure*: two MinHash values of the set of their container labels. A group of
   fewer than ``MIN_PAGES`` pages joins its host's largest group. Each group has one reference page (of least hash).
2. Every page is aligned with its group's reference by *simple tree matching*: the largest set of node pairs with equal
   labels that keeps parents and order. For each reference node the pages that have it, those with the same
   text there, and the amounts of text and of link text are added up by partial sums; no task sees a whole group.
3. Nodes that are constant over the pages become template, nodes whose text varies become slots. From the root, the
   wrapper walks into the child that holds most of the varying text, and stops where the text blocks begin: that
   node is the group's content slot. Constant containers and constant lists of links inside the slot are template.
4. Every page is aligned again, the node in the content slot is taken, and its blocks are written out. A page without
   a node there, or of a host with fewer than ``MIN_PAGES`` pages, is read by its own amounts of text.

Inside the slot only boilerplate by its element (navigation, forms, scripts, asides, …) and template nodes are left out:
paragraphs, headings, list items, cells and inline elements stay, whatever their class is and however often they repeat
over a host's pages. A class, id or role that names boilerplate (``notice``, ``search``, ``comments``, …) is a hint only: where there
is a wrapper, a node so named goes if it is constant, or if a second sign agrees: most of its text is links, or, for
adverts and comments, it repeats, or has authors, times, pictures or links. Otherwise its text varies and stays. Names
alone decide on pages without a wrapper. If the template would hold most of the slot's text, the group's pages are copies of
one article, nothing is template, and names decide.

Cost. Reading a page is linear in its length, and nothing recurses, so depth does not matter. The alignment is exact for
child lists of up to ``CELLS`` pairs and ``KINDS`` pairs of different shapes after equal heads and tails; longer lists
are cut into sections at the same relative places, and after ``WORK`` compared pairs only equal heads and tails count.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import scope
from .common import materialise, plain

MIN_PAGES = 3  # of a group, from which constant nodes can be told from varying ones
CONSTANT = 0.9  # share of a group's pages with the same text, from which a node is template
FAINT = 0.02  # weight of constant text
DOMINANT = 0.6  # share of a node's text that a child must hold to be walked into
CELLS, WORK = 1 << 20, 1 << 18  # cells of a table and sizes of pairs held at once: they bound memory and change no result
KINDS = SIDE = LONG_SIDE = 0  # without use; a test sets them

# Element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style head title nav footer aside form button select option textarea input noscript iframe svg canvas template dialog menu object embed audio video map noframes noembed xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li".split())
SECTIONS = frozenset("body div main article section table tbody tr td center span html".split())
CONTAINERS = frozenset("div section header hgroup".split())
MARKED = frozenset("div section header hgroup ul ol dl table article details fieldset li".split())  # elements whose class may name boilerplate
# Words in class, id and role that name boilerplate; of the second list also around articles
BOILERPLATE = frozenset(
    "banner breadcrumb breadcrumbs cookie cookies consent disclaimer footer header masthead menu navbar navigation nav newsletter notice notices pager pagination "
    "popup promo promoted related share sharing sidebar signup social subscribe subscription tags toolbar topbar widget widgets contentinfo complementary search".split()
)
COMMENTS_AND_ADS = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist disqus reply replies respond sponsor sponsored".split())
# Words that leave a name's meaning as it is beside one of the above
NEUTRAL = frozenset("site page top bottom left right main list box block bar area container wrapper wrap inner outer section item items link links button buttons icon icons slot unit posts global primary secondary".split())
SOFT, FIRM = 1, 2  # a soft mark is taken back if the element holds an article

# quotes open a value only after an equals sign; possessive, so one attempt is linear
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)(?:((?:=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["'])|[^>=])*+)>)?""", re.S)
_UNQUOTED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
# Words in tags and attributes of who wrote a comment and when, and of adverts
_SIGNED = re.compile(r"author|avatar|byline|username|commenter|permalink|datetime|timestamp|gravatar", re.I)
SIGNS = frozenset("time cite img iframe ins".split())
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_WHITE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    label: str
    boiler: int = 0  # FIRM or SOFT if the element is boilerplate by its own kind
    hint: int = 0  # the mark if it comes from a name only
    attributes: str = ""
    signs: int = -1  # elements of the subtree that tell of authors, times, pictures; counted when they are first asked for
    children: list = field(default_factory=list)  # Node or str, in page order
    parent: Node | None = None
    number: int = -1  # in document order
    size: int = 1  # nodes of the subtree
    nodes: list = field(default_factory=list)  # the children that are nodes
    text: int = 0  # characters below, without white space and boilerplate
    links: int = 0  # of them inside links
    holds: bool = False  # whether an article or main element is below
    digest: int = 0  # of the text below
    shape: int = 0  # of the labels of the subtree
    order: list | None = None  # all nodes in document order, at the root


def _names_boilerplate(name: str) -> int:
    """The mark of one whole class, id or role: all its words name boilerplate or are neutral beside one that does."""
    parts = {p.lower() for p in _PART.findall(name)}
    if not parts <= BOILERPLATE | COMMENTS_AND_ADS | NEUTRAL:
        return 0
    return FIRM if parts & COMMENTS_AND_ADS else SOFT if parts & BOILERPLATE else 0


def _kind(tag: str, attributes: str) -> tuple[str, int, int]:
    """(label for the alignment, whether the element is boilerplate by its own kind, the mark that its names give it)."""
    boiler, hint = FIRM if tag in DROPPED else 0, 0
    if not attributes or attributes.isspace():
        return tag, boiler, 0
    if tag in INLINE and "hidden" not in attributes and "none" not in attributes:
        return tag, boiler, 0
    label = tag
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "style" and _HIDDEN.search(value)):
            boiler = FIRM
        elif name != "style":
            if name == "class" and tag not in INLINE:
                label = f"{tag}.{_DIGITS.sub('#', value.strip().lower())}"
            if tag in MARKED:
                mark = max(map(_names_boilerplate, value.split()), default=0)
                hint = max(hint, mark if mark == FIRM or tag != "article" else 0)
    return label, boiler, hint


def _tokens(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(begin, end, slash, name, attributes) of every tag, comment and declaration; the name is "" of the latter two.

    The inside of scripts, styles and other raw text is passed over. A tag that never ends turns the reading of
    quotes off for the rest of the page, and what follows the last ``>`` holds no tag: so the whole is linear.
    """
    pattern, at, end = _TOKEN, 0, len(html)
    while m := pattern.search(html, at, end):
        if pattern is _TOKEN and m[2] is not None and m[3] is None:
            pattern, at = _UNQUOTED, m.start()
            end = max(html.rfind(">") + 1, at)
            continue
        name = (m[2] or "").lower()
        yield m.start(), m.end(), m[1] or "", name, m[3] or ""
        at = m.end()
        if name in RAW and not m[1]:
            close = _RAW_END[name].search(html, at)
            at = close.start() if close else len(html)
            yield at, at, "", "", ""  # what lies between is no text
            if at > end:
                end = len(html)


def parse(html: str) -> Node:
    """The DOM tree of a page, by the usual rules for elements that close one another."""
    root = Node("html", "html")
    stack, at, raw = [root], 0, False
    is_open: Counter = Counter()  # of the stack, by tag

    def close(k: int) -> None:
        is_open.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for begin, end, slash, tag, attributes in _tokens(html):
        if begin > at and not raw:
            stack[-1].children.append(html[at:begin])
        at, raw = end, False
        if not tag:
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1) if is_open[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray inline end tag closes nothing outside its block
            continue
        if tag in ("html", "body", "head"):
            if tag == "html":
                continue
            close(1)
        elif tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or (tag == "li" and stack[k].tag == "li") or (tag in ("dd", "dt") and stack[k].tag in ("dd", "dt")):
                    close(k)
                    break
                if stack[k].tag not in INLINE and stack[k].tag not in ("h1", "h2", "h3", "h4", "h5", "h6") or len(stack) - k > 200:
                    break
        elif tag in ("tr", "td", "th", "option"):
            same = {"tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in same:
                    close(k)
                    break
                if stack[k].tag == "table" or len(stack) - k > 200:
                    break
        label, boiler, hint = _kind(tag, attributes)
        node = Node(tag, label, max(boiler, hint), 0 if boiler else hint, parent=stack[-1], attributes=attributes)
        stack[-1].children.append(node)
        stack[-1].nodes.append(node)
        if tag in RAW:
            raw = True
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
            is_open[tag] += 1
    if not raw and at < len(html):
        stack[-1].children.append(html[at:])
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Numbers in document order, sizes, shapes, text amounts and text digests, from the leaves up."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        node.number = len(order)
        order.append(node)
        if node.nodes:
            todo.extend(reversed(node.nodes))
    root.order = order
    for node in reversed(order):
        text = links = 0
        parts = []
        for child in node.children:
            if isinstance(child, str):
                short = "".join(child.split())
                text += len(short)
                parts.append(short)
            else:
                node.size += child.size
                if not child.boiler:
                    text += child.text
                    links += child.links
                    parts.append(child.digest)
                    if child.holds or child.tag in ("article", "main"):
                        node.holds = True
                elif child.holds:
                    node.holds = True
        if node.holds and node.boiler == SOFT:
            node.boiler = node.hint = 0
        node.text, node.links = text, text if node.tag == "a" else links
        node.digest = hash(tuple(parts))
        node.shape = hash((node.label, *[c.shape for c in node.nodes]))


def _trim(x: list[Node], y: list[Node]) -> tuple[int, int]:
    """(equal shapes at the head, and then at the tail): matching them with one another is optimal."""
    most = min(len(x), len(y))
    head = 0
    while head < most and x[head].shape == y[head].shape:
        head += 1
    tail, most = 0, most - head
    while tail < most and x[-1 - tail].shape == y[-1 - tail].shape:
        tail += 1
    return head, tail


class _Columns:
    """The children of one side of a table: one node of each shape, and which of those each child is."""

    def __init__(self, nodes: list[Node]):
        kinds: dict[int, int] = {}
        self.nodes, self.at = [], np.empty(len(nodes), np.int64)
        for j, q in enumerate(nodes):
            k = kinds.setdefault(q.shape, len(kinds))
            if k == len(self.nodes):
                self.nodes.append(q)
            self.at[j] = k
        self.rows: dict[int, np.ndarray] = {}  # values by the shape of the other side's child


def _next_row(above: np.ndarray, values: np.ndarray) -> np.ndarray:
    row = above.copy()
    np.maximum(above[1:], above[:-1] + values, out=row[1:])
    return np.maximum.accumulate(row)


class _Matching:
    """Sizes of largest label- and order-preserving matchings by the shapes of two subtrees (simple tree matching).

    Exact for pages of any size: the work is at most the product of their nodes (times their depth to find the pairs), the
    memory a few rows of each open table, ``CELLS`` cells of one and ``WORK`` remembered sizes.
    """

    def __init__(self):
        self.memo: dict[tuple[int, int], int] = {}

    def known(self, a: Node, b: Node) -> int | None:
        if a.label != b.label:
            return 0
        if a.shape == b.shape:
            return a.size
        if not a.nodes or not b.nodes:
            return 1
        return self.memo.get((a.shape, b.shape))

    def _run(self, job: Generator):
        """The result of a job that yields the pairs whose sizes it needs; no recursion, as pages may be deep."""
        stack, value = [job], None
        while stack:
            try:
                pair = stack[-1].send(value)
            except StopIteration as done:
                stack.pop()
                value = done.value
            else:
                stack.append(self._size(*pair))
                value = None
        return value

    def size(self, a: Node, b: Node) -> int:
        return self._run(self._size(a, b))

    def _size(self, a: Node, b: Node) -> Generator:
        total = self.known(a, b)
        if total is None:
            x, y = a.nodes, b.nodes
            head, tail = _trim(x, y)
            total = 1 + sum(c.size for c in x[:head]) + sum(c.size for c in x[len(x) - tail :])
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if x and y:
                columns, row = _Columns(y), np.zeros(len(y) + 1, np.int64)
                for p in x:
                    row = _next_row(row, (yield from self._values(p, columns)))
                total += int(row[-1])
            if len(self.memo) >= WORK:
                self.memo.clear()
            self.memo[a.shape, b.shape] = total
        return total

    def _values(self, p: Node, columns: _Columns) -> Generator:
        """The sizes of ``p`` with every child of the other side."""
        found = columns.rows.get(p.shape)
        if found is None:
            sizes = []
            for q in columns.nodes:
                value = self.known(p, q)
                sizes.append((yield p, q) if value is None else value)
            if len(columns.rows) * len(sizes) >= CELLS:
                columns.rows.clear()
            found = columns.rows[p.shape] = np.array(sizes, np.int64)
        return found[columns.at]

    def _trace(self, x: list[Node], y: list[Node], columns: _Columns, lo: int, hi: int, row: np.ndarray, j: int, out: list) -> int:
        """Walk back from row ``hi`` and column ``j`` to row ``lo``, whose values are ``row``: pairs go to ``out``, the column there is returned."""
        if not j or lo == hi:
            return j
        if hi - lo > 1 and (hi - lo) * (j + 1) > CELLS:
            middle, there = (lo + hi) // 2, row[: j + 1]
            for p in x[lo:middle]:
                there = _next_row(there, self._run(self._values(p, columns))[:j])
            j = self._trace(x, y, columns, middle, hi, there, j, out)
            return self._trace(x, y, columns, lo, middle, row, j, out)
        rows = [row[: j + 1]]
        for p in x[lo:hi]:
            rows.append(_next_row(rows[-1], self._run(self._values(p, columns))[:j]))
        i = hi - lo
        while i and j:
            here = rows[i][j]
            if here == rows[i - 1][j]:
                i -= 1
            elif here == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((x[lo + i], y[j]))
        return j

    def pairs(self, a: Node, b: Node, in_a: list[Node], in_b: list[Node]) -> list[tuple[Node, Node]]:
        """The aligned nodes below a and b, which have equal labels; ``in_a`` and ``in_b`` are all nodes in order."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            if a.shape == b.shape:
                out += zip(in_a[a.number : a.number + a.size], in_b[b.number : b.number + b.size], strict=True)
                continue
            out.append((a, b))
            x, y = a.nodes, b.nodes
            if not x or not y:
                continue
            head, tail = _trim(x, y)
            todo += zip(x[:head], y[:head], strict=True)
            todo += zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)
            x, y = x[head : len(x) - tail], y[head : len(y) - tail]
            if x and y:
                self._trace(x, y, _Columns(y), 0, len(x), np.zeros(len(y) + 1, np.int64), len(y), todo)
        return out


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """(size, pairs of aligned nodes) of the simple tree matching of two pages."""
    if a.label != b.label:
        return 0, []
    matching = _Matching()
    return matching.size(a, b), matching.pairs(a, b, a.order, b.order)


def content_slot(root: Node, weight) -> Node:
    """Walk from the root into the child that holds most of the varying text, down to the text blocks."""
    node = root
    while True:
        inner = [c for c in node.nodes if not c.boiler and c.tag in SECTIONS]
        if not inner:
            return node
        total = weight(node)
        best = max(inner, key=weight)
        if total <= 0 or weight(best) < DOMINANT * total:
            return node
        node = best


def own_weight(node: Node) -> float:
    """Text outside of links; named sections for articles count more, as nothing else is known of a lone page."""
    return (node.text - node.links) * (1.5 if node.tag in ("article", "main") else 1.0)


def _signs(node: Node) -> int:
    if node.signs < 0:
        root = node
        while root.parent is not None:
            root = root.parent
        for n in reversed(root.order):
            n.signs = int(n.tag in SIGNS or bool(n.attributes and _SIGNED.search(n.attributes))) + sum(c.signs for c in n.nodes)
    return node.signs


def _agrees(node: Node) -> bool:
    """Whether a second sign says that a node named like boilerplate is that: links, or for adverts and comments who, when and how often."""
    inner = [c for c in node.nodes if c.hint]
    links, text = node.links + sum(c.links for c in inner), node.text + sum(c.text for c in inner)
    if links and 2 * links >= text:
        return True
    repeats = max(Counter(c.label for c in inner).values(), default=0)
    return node.hint == FIRM and (links > 0 or repeats > 1 or _signs(node) > 0)


def blocks_of(slot: Node, template: frozenset[int] = frozenset(), induced: bool = False) -> list[str]:
    """The text blocks below a slot in page order, without boilerplate and template nodes.

    With ``induced`` the template of a wrapper is known, so a name alone leaves nothing out.
    """

    def left_out(node: Node) -> bool:
        if node.number in template:
            return True
        if node.boiler:
            return not (induced and node.hint and not _agrees(node))
        return node.tag == "header" and not induced and not _heads(node)
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = _WHITE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            out.append(text)
        parts.clear()

    todo: list = [slot]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            parts.append(item)
        elif item.tag == "br":
            parts.append(" ")
        elif item is not slot and left_out(item):
            continue
        elif item.tag in INLINE:
            todo.extend(reversed(item.children))
        else:
            flush()
            todo.append(None)
            todo.extend(reversed(item.children))
    flush()
    return out


def _heads(node: Node) -> bool:
    """Whether a header element belongs to an article: it carries the heading of one."""
    inside = node.parent
    while inside is not None and inside.tag not in ("article", "main"):
        inside = inside.parent
    return inside is not None and any(c.tag in ("h1", "h2") for c in node.nodes)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def structure_key(html: Column) -> Column:
    """Two MinHash values of the set of a page's container labels: pages of one template mostly agree in both."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:div|section|article|main|table|ul|ol|header|aside|form|nav|footer)\b[^>]{0,400}"), F.lit(0))
    label = lambda t: F.regexp_replace(
        F.lower(F.concat_ws(".", F.regexp_extract(t, r"<(\w+)", 1), F.regexp_extract(t, r"""(?i)\bclass\s*=\s*["']?([^"'>]*)""", 1))), r"\d+", "#"
    )
    labels = F.array_distinct(F.transform(tags, label))
    least = lambda k: F.coalesce(F.array_min(F.transform(labels, lambda x: F.xxhash64(x, F.lit(k)))), F.lit(0))
    return F.xxhash64(least(0), least(1))


class _Trees:
    """Parsed reference pages by their text; bounded by their characters."""

    def __init__(self, most_chars: int = 4 << 20):
        self.most, self.chars, self.trees = most_chars, 0, {}

    def __call__(self, html: str) -> Node:
        tree = self.trees.get(html)
        if tree is None:
            if self.chars > self.most:
                self.trees.clear()
                self.chars = 0
            tree = self.trees[html] = parse(html)
            self.chars += len(html)
        return tree


def references(pages: DataFrame) -> DataFrame:
    """(host, key, grp, ref): the group of every structure key and the reference page of that group.

    A host of fewer than MIN_PAGES pages has no reference: nothing could be told constant or varying there.
    """
    some = pages.filter(F.length(F.trim("html")) > 0)
    found = some.groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("html", F.xxhash64("page_id", "url", "html")).alias("ref"))
    found = materialise(found, "structures")
    hosts = found.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "key")).alias("most")).filter(F.col("pages") >= MIN_PAGES)
    large = found.filter(F.col("n") >= MIN_PAGES).select("host", "key", F.col("key").alias("grp"), "ref")
    small = found.filter(F.col("n") < MIN_PAGES).select("host", "key").join(hosts.select("host", F.col("most.key").alias("grp")), "host")
    small = small.join(found.select("host", F.col("key").alias("grp"), "ref"), ["host", "grp"])
    return large.unionByName(small)


def bounded(df: DataFrame, size: Column, most_bytes: int) -> DataFrame:
    """A broadcast hint if the rows hold at most ``most_bytes`` by ``size``; else Spark shuffles both sides."""
    held = df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return F.broadcast(df) if held <= most_bytes else df


def node_counts(pages: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, grp, ref, nodes): per reference node (node, pages, same, text, links) added up over the pages of a group."""
    joined = pages.filter("html is not null").join(refs, ["host", "key"]).select("host", "grp", "html", "ref")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree_of = _Trees()
        for batch in batches:
            sums: dict[tuple, list] = {}
            for host, grp, html, ref in zip(batch["host"], batch["grp"], batch["html"], batch["ref"], strict=True):
                tree = tree_of(ref)
                by_node = sums.get((host, grp))
                if by_node is None:
                    by_node = sums[host, grp] = [None] * len(tree.order)
                for one, mine in align(tree, parse(html))[1]:
                    s = by_node[one.number]
                    if s is None:
                        s = by_node[one.number] = [0, 0, 0, 0]
                    s[0] += 1
                    s[1] += one.digest == mine.digest
                    s[2] += mine.text
                    s[3] += mine.links
            out = [(*key, k, *s) for key, by_node in sums.items() for k, s in enumerate(by_node) if s is not None]
            yield plain(pd.DataFrame(out, columns=["host", "grp", "node", "pages", "same", "text", "links"]), "host")

    partial = joined.mapInPandas(run, "host string, grp long, node int, pages long, same long, text long, links long")
    sums = partial.groupBy("host", "grp", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "same", "text", "links")])
    # at most as many nodes as the reference page has
    return sums.groupBy("host", "grp").agg(F.sort_array(F.collect_list(F.struct("node", "pages", "same", "text", "links"))).alias("nodes"))


def wrapper(ref: Node, nodes: list) -> tuple[int, list[int], bool]:
    """(number of the content slot, numbers of the template nodes inside it, whether constant and varying could be told there) of a reference from its counts."""
    seen = {s["node"]: s for s in nodes}
    constant = lambda k: k in seen and seen[k]["pages"] >= MIN_PAGES and seen[k]["same"] >= CONSTANT * seen[k]["pages"]

    plain_text = lambda k: seen[k]["text"] - seen[k]["links"] if k in seen else 0
    varying: dict[int, float] = {}
    for node in reversed(ref.order):
        k, inner = node.number, [c.number for c in node.nodes if not c.boiler]
        # what no child holds, or held on pages where the child was not found, varies
        varying[k] = FAINT * plain_text(k) if constant(k) else plain_text(k) + sum(varying[c] - plain_text(c) for c in inner)

    slot = content_slot(ref, lambda node: varying[node.number])
    template, held = [], 0
    todo = [] if constant(slot.number) else [*slot.nodes]
    while todo:
        node = todo.pop()
        s = seen.get(node.number)
        if s and node.hint and constant(node.number):
            template.append(node.number)
        elif s and not node.boiler and constant(node.number) and (node.tag in CONTAINERS or (node.tag not in INLINE and s["text"] and 2 * s["links"] >= s["text"])):
            template.append(node.number)
            held += s["text"]
        elif node.hint or not node.boiler:
            todo += node.nodes
    told = slot.number in seen and seen[slot.number]["pages"] >= MIN_PAGES and not constant(slot.number)
    if 2 * held > (seen[slot.number]["text"] if slot.number in seen else 0):
        template, told = [], False
    return slot.number, sorted(template), told


def page_text(html: str | None, ref: Node | None, slot: int = -1, template: list[int] = (), told: bool = False) -> str:
    """The main text of a page, given the reference tree of its group, the slot, the template nodes there and whether they tell template from content."""
    if not html:
        return ""
    page = parse(html)
    node, constant = None, frozenset()
    if ref is not None:
        at = {a.number: b for a, b in align(ref, page)[1]}
        node, constant = at.get(slot), frozenset(at[c].number for c in template if c in at)
    if node is None or (node.text == 0 and page.text > 0):
        node, constant, told = content_slot(page, own_weight), frozenset(), False
    return "\n".join(blocks_of(node, constant, told))


def wrappers(pages: DataFrame, most_bytes: int) -> DataFrame:
    """(host, key, ref, slot, template) for the structure keys of ``pages`` (page_id, url, html, host, key)."""
    refs = materialise(references(pages), "references")
    counts = node_counts(pages, bounded(refs, F.octet_length("ref") + 64, most_bytes))
    groups = refs.filter("key = grp").select("host", "grp", "ref").join(counts, ["host", "grp"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [wrapper(parse(ref), nodes) for ref, nodes in zip(batch["ref"], batch["nodes"], strict=True)]
            out = pd.DataFrame({"host": batch["host"], "grp": batch["grp"], "slot": [f[0] for f in found], "template": [f[1] for f in found], "told": [f[2] for f in found]})
            yield plain(out, "host")

    made = groups.mapInPandas(run, "host string, grp long, slot int, template array<int>, told boolean")
    return materialise(refs.join(made, ["host", "grp"]).drop("grp"), "wrappers")


def main_text(pages: DataFrame, most_bytes: int = 16 << 20, induce: bool = True) -> DataFrame:
    """(page_id, url, text): the main text of every row of ``pages`` (page_id, url, html).

    A null or empty html gives an empty text. A null url, or one without a host, counts as the empty
    host. Rows may repeat; each gets its text. Broken markup is read as far as it goes, pages of any depth and lists
    of any length are read. Other columns are not carried. ``most_bytes`` bounds the reference pages that are
    broadcast; beyond it they are joined by a shuffle. Without ``induce`` each page is read alone.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), structure_key(F.coalesce("html", F.lit(""))).alias("key"))
    if induce:
        with scope(pages.sparkSession, keep=("wrappers",)):
            known = wrappers(rows, most_bytes)
        joined = rows.join(bounded(known, F.octet_length("ref") + 4 * F.size("template") + 64, most_bytes), ["host", "key"], "left").select("page_id", "url", "html", "ref", "slot", "template", "told")
    else:
        joined = rows.select("page_id", "url", "html", F.lit(None).cast("string").alias("ref"), F.lit(-1).alias("slot"), F.array().cast("array<int>").alias("template"), F.lit(False).alias("told"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree_of = _Trees()
        for batch in batches:
            texts = [
                page_text(html, None if pd.isna(slot) or slot < 0 else tree_of(ref), -1 if pd.isna(slot) else int(slot), template if template is not None else (), told is not None and not pd.isna(told) and bool(told))
                for html, ref, slot, template, told in zip(batch["html"], batch["ref"], batch["slot"], batch["template"], batch["told"], strict=True)
            ]
            yield plain(pd.DataFrame({"page_id": batch["page_id"].to_numpy(), "url": batch["url"], "text": texts}), "url", "text")

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInPandas(run, f"page_id {kind}, url string, text string")
