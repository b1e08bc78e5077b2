"""Main text of web pages by wrapper induction.

Every page of a host is parsed and its DOM tree aligned with that of the host's first page (that of the smallest hash of
the id) by simple tree matching: two nodes match if tag, class, id and role agree, and the matching keeps the
order of children and as many nodes as it can. How many pages have a text in a place is counted over all different pages of
the host; a place is a node of the first page, or the path of labels of a block that it has no match for. Blocks that keep
the same text on (nearly) all pages are the template of the host. Subtrees whose text varies are its slots; slots
of articles are content, those of menus, headers, footers, side columns, notices, adverts, forms and comments
are not, told by element, class, id or role names, or, where these say nothing,
by how much of the text is in links. A form, or a name such as ``page-with-sidebar`` that only in part tells of
something else, does not put an article aside that has more text than all articles, main elements or content names
(whichever of these the page has) elsewhere on the page. The host's content slot is the one with most varying text.

The same is done for each layout of a host with several: pages that open the same set of containers, told by element, class,
id and role with numbers of two digits or more aside. Every page is then read with its host's wrapper and that of its layout.

A page is aligned with one or two first pages and gives one row of numbers for each; rows of pages with the same
text are one, and what they count is added up before the shuffle, so a host with a third of all pages sends little more
than others. A wrapper is a few numbers a template block.

Nulls and odd rows: null and empty html gives an empty text; urls that are null or have no
host share one wrapper; repeated rows are pages of their own, but count once in a wrapper; pages of a
host with fewer than ``ALIGNED`` different pages have no template and are read by
names alone, layouts with fewer have the host's; broken markup is read as browsers would, unclosed elements end with their
parents; very long pages are parsed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import stored
from linewatch.llm.dom import BLOCK, RAW, Node, parse

ALIGNED = 3
#: A text is template if this share of the aligned pages has it in the same place.
CONSTANT = 0.8
#: Nodes of first pages and of shapes that a task keeps, and as many pairs in plans.
KEPT = 300_000
#: Children compared at most by the quadratic matching; more are matched in order.
WIDE = 200

# Names that pages give to what is not their main text
OTHER_TAGS = frozenset("""nav footer aside form script style noscript template iframe object svg canvas button input
    select textarea label dialog head title menu search datalist audio video map""".split())
OTHER_NAMES = frozenset("""nav navbar navigation menu menubar topnav breadcrumb breadcrumbs header masthead banner topbar
    footer colophon bottom sidebar aside rail widget widgets notice notices cookie cookies consent gdpr alert alerts
    popup modal overlay ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted
    form login signup search subscribe newsletter comment comments commentlist disqus respond replies reply discussion
    share sharing social related recommended pagination pager skip toolbar toc complementary contentinfo dialog
    alertdialog status tooltip copyright legal disclaimer paywall""".split())
#: Names that an article's own heading or sections have too.
HEADINGS = frozenset("header banner masthead status bottom form discussion".split())
#: Parts of names that tell of the page's layout as well as of something else.
LAYOUT = frozenset("""nav navbar navigation menu menubar topnav breadcrumb breadcrumbs header masthead banner topbar footer
    bottom sidebar aside rail widget widgets form search skip toolbar toc""".split())
CONTENT_NAMES = frozenset("""article articlebody article-body article-content content main main-content maincontent
    post-content post-body entry-content story storybody story-body post entry body-text""".split())
#: Opening tags that tell layouts apart, and what is taken of them.
CONTAINER = r"(?i)<(?:body|main|article|section|nav|header|footer|aside|div|form)(?=[\s/>])[^>]*>"
LABEL = r"""^<[a-z]+|\s(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def _names(node: Node) -> Iterator[str]:
    for mark in node.marks:
        kind, _, value = mark.partition("=")
        if kind in ("class", "id", "role"):
            yield value


def _aside(node: Node, inside: bool) -> int:
    """Whether names say that a node is not main text: 2, or 1 where it may yet hold an article, or 0.
    ``inside``: it is within an article."""
    if node.tag == "form":
        return 1
    if node.tag in OTHER_TAGS or node.tag in RAW or "hidden" in node.marks:
        return 2
    if node.tag == "header":
        return 0 if inside else 2
    if node.tag in ("html", "body", "main") or node.tag == "article" and not inside:
        return 0
    names = list(_names(node))
    if any(name in OTHER_NAMES - HEADINGS for name in names):
        return 2
    if any(name in CONTENT_NAMES for name in names):
        return 0
    off = OTHER_NAMES - HEADINGS if inside else OTHER_NAMES
    if any(name in off for name in names):
        return 2
    found = {part for name in names for part in re.split(r"[-_]+", name) if part in off}
    return 0 if not found else 1 if found <= LAYOUT else 2


def _content(node: Node) -> bool:
    return node.tag == "article" or node.tag not in ("html", "body") and any(n in CONTENT_NAMES for n in _names(node))


def _text(node: Node) -> str:
    out: list[str] = []
    _gather(node, out)
    return " ".join("".join(out).split())


def _gather(node: Node, out: list[str]) -> None:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag not in RAW:
            out.append(" ")
            stack.extend(reversed(x.children))


def _nodes(node: Node) -> list[Node]:
    return [c for c in node.children if not isinstance(c, str) and c.tag not in RAW and c.tag != "head"]


class Shapes:
    """Numbers of tree shapes (a label and the shapes of the children), and how trees of two shapes are matched."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, tuple[int, ...]], int] = {}
        self.found: list[tuple[str, tuple[int, ...]]] = []
        self.plans: dict[tuple[int, int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.size = self.planned = 0

    def of(self, label: str, children: tuple[int, ...]) -> int:
        number = self.number.setdefault((label, children), len(self.found))
        if number == len(self.found):
            self.found.append((label, children))
            self.size += 1 + len(children)
        return number

    def alike(self, x: int, y: int) -> bool:
        return self.found[x][0] == self.found[y][0]

    def plan(self, x: int, y: int, depth: int = 0) -> tuple[int, list[tuple[int, int]]]:
        """How many pairs of nodes two trees give, and which of their children are matched with each other."""
        (label, kids), (other, others) = self.found[x], self.found[y]
        if label != other:
            return 0, []
        if not kids or not others or depth > 60:
            return 1, []
        if (x, y, depth) not in self.plans:
            pairs = _ordered(kids, others, self.alike, lambda p, q: self.plan(p, q, depth + 1)[0])
            self.plans[x, y, depth] = 1 + sum(self.plan(kids[i], others[j], depth + 1)[0] for i, j in pairs), pairs
            self.planned += 1 + len(pairs)
        return self.plans[x, y, depth]

    def forget(self) -> None:
        """Plans are made again where they are needed."""
        self.plans.clear()
        self.planned = 0


class Tree:
    """The nodes of a page in the order of ``_paths``, by their number: places of children and parents, shapes."""

    def __init__(self, root: Node, shapes: Shapes) -> None:
        self.nodes: list[Node] = []
        self.kids: list[list[int]] = []
        self.above: list[int] = []
        stack = [(root, -1)]
        while stack:
            node, above = stack.pop()
            i = len(self.nodes)
            if above >= 0:
                self.kids[above].append(i)
            self.nodes.append(node)
            self.kids.append([])
            self.above.append(above)
            stack.extend((c, i) for c in reversed(_nodes(node)))
        self.shape = [0] * len(self.nodes)
        for i in range(len(self.nodes) - 1, -1, -1):
            self.shape[i] = shapes.of(self.nodes[i].label, tuple(self.shape[k] for k in self.kids[i]))

    def pairs(self, other: Tree, shapes: Shapes) -> list[tuple[int, int]]:
        """Simple tree matching: the most pairs of nodes that keep order and ancestry."""
        found = []
        stack = [(0, 0, 0)] if shapes.alike(self.shape[0], other.shape[0]) else []
        while stack:
            p, q, depth = stack.pop()
            found.append((p, q))
            stack.extend((self.kids[p][i], other.kids[q][j], depth + 1) for i, j in shapes.plan(self.shape[p], other.shape[q], depth)[1])
        return found


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two trees: how many pairs of nodes, and the pairs."""
    shapes = Shapes()
    x, y = Tree(a, shapes), Tree(b, shapes)
    return shapes.plan(x.shape[0], y.shape[0])[0], [(x.nodes[i], y.nodes[j]) for i, j in x.pairs(y, shapes)]


def _ordered(x: tuple[int, ...], y: tuple[int, ...], alike: Callable[[int, int], bool], size: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Places of children that are matched with each other, given how many pairs each two give."""
    # What is equal at both ends is matched as it stands; only the rest needs the table.
    least = min(len(x), len(y))
    head = 0
    while head < least and alike(x[head], y[head]):
        head += 1
    tail = 0
    while tail < least - head and alike(x[-1 - tail], y[-1 - tail]):
        tail += 1
    pairs = [(i, i) for i in range(head)] + [(len(x) - k, len(y) - k) for k in range(1, tail + 1)]
    m, n = len(x) - tail - head, len(y) - tail - head
    pairs += [(head + k, head + k) for k in range(WIDE, min(m, n)) if alike(x[head + k], y[head + k])]
    m, n = min(m, WIDE), min(n, WIDE)
    if not m or not n:
        return pairs
    rows, row = np.unique(x[head:head + m], return_inverse=True)
    columns, column = np.unique(y[head:head + n], return_inverse=True)
    each = np.array([[size(p, q) for q in columns.tolist()] for p in rows.tolist()])[row][:, column]
    best = np.zeros((m + 1, n + 1), int)
    for i in range(m):
        np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + each[i]), out=best[i + 1, 1:])
    i, j = m, n
    while i and j:
        if each[i - 1, j - 1] and best[i, j] == best[i - 1, j - 1] + each[i - 1, j - 1]:
            i, j = i - 1, j - 1
            pairs.append((head + i, head + j))
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            j -= 1
    return pairs


def _paths(root: Node, opened: frozenset[int] = frozenset()) -> Iterator[tuple[str, Node, bool, int]]:
    """Every node with its path of labels, whether it is in an article, and whether it is put aside, as
    ``_aside`` says of it and the nodes around it. Nodes ``opened`` are not put aside."""
    stack = [("", root, False, 0)]
    while stack:
        path, node, inside, off = stack.pop()
        if id(node) not in opened:
            off = max(off, _aside(node, inside))
        yield path, node, inside, off
        inside = inside or _content(node)
        for child in reversed(_nodes(node)):
            stack.append((f"{path}/{child.label}", child, inside, off))


def _tops(found: list[tuple[str, Node, bool, int]], off: int = 0) -> list[Node]:
    """The outermost articles, or else main elements and content names, put aside up to ``off``."""
    nodes = [n for _, n, inside, aside in found if aside <= off and not inside]
    return ([n for n in nodes if n.tag == "article" or "itemprop=articlebody" in n.marks]
            or [n for n in nodes if n.tag == "main" or "role=main" in n.marks or _content(n)])


def _opened(root: Node, found: list[tuple[str, Node, bool, int]]) -> frozenset[int]:
    """Forms and parts of the layout around the longest article, if nothing beside them has as much text."""
    if not any(off == 1 and (_content(n) or n.tag == "main" or "role=main" in n.marks or "itemprop=articlebody" in n.marks)
               for _, n, _, off in found):
        return frozenset()
    clear = _tops(found)
    taken = {id(n) for n in clear}
    size = sum(len(_shown(n)) for n in clear)
    best = None
    for top in _tops(found, off=1):
        if id(top) not in taken and (n := len(_shown(top))) > size:
            best, size = top, n
    # an article within a main element is put aside by the layout around it
    for top in clear:
        for _, node, _, off in _paths(top):
            if off == 1 and node.tag == "article" and (n := len(_text(node))) > size:
                best, size = node, n
    if best is None:
        return frozenset()
    above: dict[int, Node] = {}
    stack = [root]
    while stack:
        node = stack.pop()
        for child in _nodes(node):
            above[id(child)] = node
            stack.append(child)
    opened, node = set(), best
    while id(node) in above:
        opened.add(id(node))
        node = above[id(node)]
    return frozenset(opened)


def _shown(top: Node) -> str:
    """Text of a node without what its own names put aside."""
    out: list[str] = []
    stack: list = [(top, True)]
    while stack:
        node, first = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag not in RAW and (first or not _aside(node, True)):
            out.append(" ")
            stack.extend((c, False) for c in reversed(node.children))
    return " ".join("".join(out).split())


def _code(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


@functools.lru_cache(maxsize=1 << 14)
def _place(path: str, inside: bool) -> int:
    """A negative number for a path of labels, odd within articles."""
    return (_code(path) & (1 << 63) - 1 | 1) - (not inside) - (1 << 63)


def _texts(root: Node) -> tuple[str, dict[int, tuple[int, int]]]:
    """All text, and from where to where in it each node has its own."""
    out: list[str] = []
    spans: dict[int, tuple[int, int]] = {}
    size = 0
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
            size += len(x)
        elif isinstance(x, tuple):
            spans[x[0]] = (x[1], size)
        elif x.tag not in RAW:
            stack.append((id(x), size))
            out.append(" ")
            size += 1
            stack.extend(reversed(x.children))
    return "".join(out), spans


class Page(Tree):
    """A page that is aligned with first pages."""

    def __init__(self, root: Node, shapes: Shapes) -> None:
        super().__init__(root, shapes)
        self.shapes = shapes
        self.whole, self.spans = _texts(root)
        self.texts: dict[int, tuple[int, int]] = {}

    def text(self, i: int) -> tuple[int, int]:
        """Code (0 where empty or no block) and length of a node's text."""
        if i not in self.texts:
            begin, end = self.spans[id(self.nodes[i])]
            text = " ".join(self.whole[begin:end].split())
            self.texts[i] = _code(text) if text and self.nodes[i].tag in BLOCK else 0, len(text)
        return self.texts[i]

    def counted(self, first: Tree) -> Iterator[tuple[int, int, int]]:
        """What the page counts: place, code of the text, length of the text. Place 0 is the page, nodes of the first page are
        numbered from 1 on."""
        yield 0, 0, 0
        partners = {j: i + 1 for i, j in first.pairs(self, self.shapes)}
        ways = [("", False)]
        others: set[tuple[int, int]] = set()
        for i, node in enumerate(self.nodes):
            if i:
                path, inside = ways[self.above[i]]
                ways.append((f"{path}/{node.label}", inside or _content(self.nodes[self.above[i]])))
            if node.tag in ("#root", "html", "body") or i not in partners and node.tag not in BLOCK:
                continue
            code, size = self.text(i)
            if i in partners:
                yield partners[i], code, size
            elif size and (other := (_place(*ways[i]), code)) not in others:
                others.add(other)
                yield *other, 0


def induce(page: str, counts: dict[int, tuple[int, int, int, int]]) -> dict:
    """The wrapper of the pages aligned with ``page``: ``constant`` (places and codes of template texts) and ``slot`` (path
    of the content slot, or null). ``counts``: for each place the pages that have it, the length of their texts, the text
    that most of them have and how many these are."""
    pages = counts[0][0]
    if pages < ALIGNED:
        return {"constant": [], "slot": None}
    root = parse(page)

    def same(place: int, inside: bool) -> bool:
        _, _, code, most = counts.get(place, (0, 0, 0, 0))
        return code != 0 and most >= CONSTANT * pages and most >= (ALIGNED if not inside else ALIGNED + 1)

    constant = [[place, count[2]] for place, count in counts.items() if place < 0 and same(place, bool(place & 1))]
    varying: Counter[str] = Counter()
    for i, (path, node, inside, off) in enumerate(_paths(root, _opened(root, list(_paths(root)))), 1):
        if node.tag in ("#root", "html", "body") or i not in counts:
            continue
        if same(i, inside):
            constant.append([_place(path, inside), counts[i][2]])
        elif not off and counts[i][0] > 1:
            linked = sum(len(_text(n)) for n in _links(node))
            if linked * 2 < len(_text(node)):
                varying[path] += counts[i][1]
    slot = None
    if varying:
        most = max(varying.values())
        near = [p for p, n in varying.items() if n >= 0.9 * most]
        slot = max(near, key=lambda p: p.count("/"))  # the deepest that still has nearly all of it
        while slot.rpartition("/")[2].split(" ")[0] not in ("article", "main", "section", "div", "td"):
            if slot.count("/") <= 2:
                slot = None
                break
            slot = slot.rpartition("/")[0]
    return {"constant": constant, "slot": slot}


def _links(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        for c in _nodes(x):
            if c.tag == "a":
                yield c
            else:
                stack.append(c)


def joined(*wrappers: str | None) -> dict:
    """What ``main_text`` reads pages with: template texts by place of all the wrappers, and their slots in turn."""
    constant: dict[int, set[int]] = {}
    slots = []
    for wrapper in (json.loads(w) for w in wrappers if w is not None):
        for place, code in wrapper["constant"]:
            constant.setdefault(place, set()).add(code)
        slots += [wrapper["slot"]] if wrapper["slot"] is not None else []
    return {"constant": constant, "slots": slots}


def main_text(page: str | None, wrapper: dict | None) -> str:
    """Blocks of the content, one a line."""
    if not page:
        return ""
    root = parse(page)
    wrapper = wrapper or joined()
    constant = wrapper["constant"]
    found = list(_paths(root))
    opened = _opened(root, found)
    if opened:
        found = list(_paths(root, opened))
    tops = _tops(found)
    starts = {id(n) for n in tops}
    slot = None
    if wrapper["slots"] and not tops:
        paths = {p for p, *_ in found}
        slot = next((s for s in wrapper["slots"] if s in paths), None)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if block := " ".join("".join(line).split()):
            blocks.append(block)
        line.clear()

    # (path, node, inside an article, within the content, leaving)
    stack: list = [("", root, False, not starts and slot is None, False)]
    while stack:
        path, node, inside, within, leaving = stack.pop()
        if isinstance(node, str):
            if within:
                line.append(node)
            continue
        if leaving:
            flush()
            continue
        if _aside(node, inside) and id(node) not in opened or constant and node.tag in BLOCK and (
                codes := constant.get(_place(path, inside))) and _code(_text(node)) in codes:
            if node.tag in BLOCK:
                flush()
            continue
        within = within or id(node) in starts or path == slot
        if node.tag in BLOCK:
            flush()
            stack.append((path, node, inside, within, True))
        elif node.tag in ("br", "hr", "img", "wbr") and within:
            line.append("" if node.tag == "wbr" else " ")
        deeper = inside or _content(node)
        for child in reversed(node.children):
            if isinstance(child, str):
                stack.append(("", child, deeper, within, False))
            elif child.tag not in RAW and child.tag != "head":
                stack.append((f"{path}/{child.label}", child, deeper, within, False))
    flush()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(found, F.lit(""))


def layout(html: Column) -> Column:
    """Tells layouts apart: a hash of the different containers that a page opens, with class, id and role, numbers of two digits or more aside."""
    tags = F.regexp_extract_all(html, F.lit(CONTAINER), F.lit(0))

    def label(tag: Column) -> Column:
        return F.regexp_replace(F.concat_ws("", F.regexp_extract_all(F.lower(tag), F.lit(LABEL), F.lit(0))), r"[0-9]{2,}", "#")

    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(F.array_distinct(tags), label))))


def _firsts(rows: DataFrame) -> DataFrame:
    """``id``, host, layout (null for the whole host) and html of the first page of each host and, where a host has several,
    of each of its layouts, of those with ``ALIGNED`` pages or more."""
    sizes = stored(rows.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("hash").alias("hash")), "layouts")
    hosts = sizes.groupBy("host").agg(F.sum("n").alias("n"), F.min("hash").alias("hash"), F.count("*").alias("layouts"))
    several = hosts.where("layouts > 1").select(F.col("host").alias("_several"))
    groups = hosts.select("host", F.lit(None).cast("long").alias("layout"), "n", "hash").unionByName(
        sizes.join(several, F.col("host") == F.col("_several"), "left_semi")).where(F.col("n") >= ALIGNED)
    groups = groups.select(*(F.col(c).alias(f"_{c}") for c in ("host", "layout", "hash")))
    first = rows.drop("layout").join(groups, (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash"))
                                     & (F.col("_layout").isNull() | (layout(F.col("html")) == F.col("_layout"))))
    found = first.groupBy("host", F.col("_layout").alias("layout")).agg(F.min(F.struct("page_id", "html")).alias("first"))
    return stored(found.select(F.monotonically_increasing_id().alias("id"), "host", "layout", "first.html"), "firsts")


def _aligned(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """One row a first page and page aligned with it: ``id``, a digest of the page's text, hash and id of the page, and
    arrays of what ``Page.counted`` says."""
    hosts = firsts.where("layout is null").select(F.col("host").alias("_host"), F.col("id").alias("id_0"), F.col("html").alias("first_0"))
    layouts = firsts.where("layout is not null").select(
        F.col("host").alias("_host_1"), F.col("layout").alias("_layout"), F.col("id").alias("id_1"), F.col("html").alias("first_1"))
    both = rows.join(hosts, F.col("host") == F.col("_host")).join(
        layouts, (F.col("host") == F.col("_host_1")) & (F.col("layout") == F.col("_layout")), "left")
    both = both.select("html", "hash", "page_id", "id_0", "first_0", "id_1", F.when(
        ~F.col("first_1").eqNullSafe(F.col("first_0")), F.col("first_1")).alias("first_1"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes, known, kept = Shapes(), {}, 0

        def first(i: int, page: pa.StringScalar) -> Tree:
            nonlocal kept
            if i not in known:
                known[i] = Tree(parse(page.as_py()), shapes)
                known[i].nodes = []
                kept += len(known[i].kids)
            return known[i]

        def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, list[tuple[int, int, int]]]]:
            nonlocal shapes, known, kept
            pages, _, _, hosts, first_0, layouts, first_1 = batch.columns
            for k, (page, i, j) in enumerate(zip(pages, hosts.to_pylist(), layouts.to_pylist(), strict=True)):
                if kept + shapes.size > KEPT:
                    shapes, known, kept = Shapes(), {}, 0
                if shapes.planned > KEPT:
                    shapes.forget()
                found = Page(parse(page.as_py()), shapes)
                digest = blake2b(" ".join(found.whole.split()).encode(), digest_size=16).digest()
                counts = list(found.counted(first(i, first_0[k])))
                yield k, i, digest, counts
                if j is not None:
                    yield k, j, digest, list(found.counted(first(j, first_1[k]))) if first_1[k].is_valid else counts

        def packed(batch: pa.RecordBatch, found: list[tuple[int, int, bytes, list[tuple[int, int, int]]]]) -> pa.RecordBatch:
            take, ids, digests, counts = zip(*found, strict=True)
            ends = pa.array([0, *itertools.accumulate(map(len, counts))], pa.int32())
            at = pa.array(take, pa.int64())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in zip(*itertools.chain(*counts), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), batch.column(1).take(at), batch.column(2).take(at), *lists],
                ["id", "digest", "hash", "page_id", "place", "code", "size"])

        for batch in batches:
            found, size = [], 0
            for row in rows(batch):
                found.append(row)
                size += len(row[3])
                if size > 100_000:
                    yield packed(batch, found)
                    found, size = [], 0
            if found:
                yield packed(batch, found)

    return both.mapInArrow(align, "id long, digest binary, hash long, page_id long, place array<long>, code array<long>, size array<long>")


def wrappers(pages: DataFrame) -> DataFrame:
    """Host, layout (null for the whole host) and the wrapper as JSON, of each host and layout that ``_firsts`` finds."""
    rows = pages.where("html <> ''").select(host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout"),
                                            F.xxhash64("page_id").alias("hash"), "page_id", "html")
    firsts = _firsts(rows)
    different = _aligned(rows, firsts).groupBy("id", "digest").agg(
        F.min(F.struct("hash", "page_id", "place", "code", "size")).alias("page"))
    texts = different.select("id", F.inline(F.arrays_zip("page.place", "page.code", "page.size"))).toDF("id", "place", "code", "size") \
        .groupBy("id", "place", "code").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    places = texts.groupBy("id", "place").agg(
        F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by("code", "n").alias("code"), F.max("n").alias("most")
    ).where((F.col("place") >= 0) | (F.col("most") >= ALIGNED))
    counts = places.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("place", "n", "size", "code", "most")).alias("counts"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [json.dumps(induce(page.as_py(), {c["place"]: (c["n"], c["size"], c["code"], c["most"]) for c in counts.as_py()}))
                     for page, counts in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["host", "layout", "wrapper"])

    return firsts.join(counts, F.col("id") == F.col("_id")).select("host", "layout", "html", "counts").mapInArrow(
        learn, "host string, layout long, wrapper string")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""
    learnt = stored(wrappers(pages), "wrappers")
    hosts = learnt.where("layout is null").select(F.col("host").alias("_host"), "wrapper")
    layouts = learnt.where("layout is not null").select(
        F.col("host").alias("_host_1"), F.col("layout").alias("_layout"), F.col("wrapper").alias("own"))
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), layout(F.col("html")).alias("layout")).join(
        hosts, F.col("host") == F.col("_host"), "left").join(
        layouts, (F.col("host") == F.col("_host_1")) & (F.col("layout") == F.col("_layout")), "left").select(
        "page_id", "url", "html", "own", "wrapper")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str | None, str | None], dict] = {}
        for batch in batches:
            texts = []
            for page, *both in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if (key := tuple(both)) not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[key] = joined(*key)
                texts.append(main_text(page.as_py(), known[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    return rows.mapInArrow(read, "page_id long, url string, text string")
