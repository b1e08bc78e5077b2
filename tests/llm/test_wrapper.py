"""Wrappers are induced from all pages of a host and of its layouts."""

import collections
import itertools
import json
import random

from pyspark.sql import functions as F

from linewatch.llm import wrapper
from linewatch.llm.dom import Node, parse

SCHEMA = "page_id long, url string, html string"


def in_order(spark, n):
    """Ids below ``n`` in the order in which pages come first."""
    return [r["id"] for r in spark.range(n).orderBy(F.xxhash64("id"), "id").collect()]


def body(i):
    return " ".join(f"word{i * 7 + k}" for k in range(12))


def texts(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    return {r["page_id"]: r["text"] for r in wrapper.extracted(df).collect()}


def test_all_pages_of_a_host_count(spark):
    """Two of the first pages have another strip than the other 38; the first six share a line that later pages have not."""
    order = in_order(spark, 40)
    strip = {i: f"Strip of {i}" if k < 2 else "Buy our paper today" for k, i in enumerate(order)}
    line = {i: "A line of its own" if k < 6 else f"A line of {i}" for k, i in enumerate(order)}
    got = texts(spark, [(i, f"http://h.example/{i}", f"<body><div class=text><div class=strip>{strip[i]}</div><p>{line[i]}</p><p>{body(i)}</p></div>")
                        for i in range(40)])
    assert got == {i: "\n".join([f"Strip of {i}"] * (i in order[:2]) + [line[i], body(i)]) for i in range(40)}


def test_blocks_that_the_first_page_lacks(spark):
    order = in_order(spark, 20)
    box = {i: "<div class=box><p>Read our terms</p></div>" if i != order[0] else "" for i in order}
    got = texts(spark, [(i, f"http://h.example/{i}", f"<body><div class=text><p>{body(i)}</p>{box[i]}</div>") for i in range(20)])
    assert got == {i: body(i) for i in range(20)}


def test_layouts_of_a_host(spark):
    """Three layouts with a third of the pages each, all with template blocks of their own, and their content in other places."""
    kinds = ["<body class=a><div class=strip>Strip of a</div><div id=x-1{i:03}><p>{text}</p></div>",
             "<body class=b><div class=leaf><div class=list><p>List of b</p></div><p>{text}</p></div><div class=more>{i} more of b</div>",
             "<body class=b><div class=page><div class=list><p>List of c</p></div><p>{text}</p></div><div class=more>{i} more of c</div>"]
    pages = [(i, f"http://h.example/{i}", kinds[i % 3].format(i=i, text=body(i))) for i in range(45)]
    pages.append((99, "http://h.example/99", "<body class=d><div class=strip>Strip of d</div><p>Alone</p>"))
    assert texts(spark, pages) == {i: body(i) for i in range(45)} | {99: "Strip of d\nAlone"}


def test_wrappers_count_like_plain_python(spark):
    """Counts over all different pages, aligned one by one with the first."""
    rng = random.Random(5)

    def page(i):
        parts = [f"<div class=top>{'Top' if rng.random() < 0.85 else f'Top {i}'}</div>"]
        parts += [f"<div class=note><p>{rng.choice(['Note', 'Note', f'Note {i}'])}</p></div>"] * (rng.random() < 0.9)
        parts.append("<article>" + "".join(f"<{t}>{rng.choice(['Same', f'{t} {i} {rng.random()}'])}</{t}>"
                                           for t in rng.choices(["p", "h2", "ul", "blockquote"], k=rng.randrange(1, 9))) + "</article>")
        parts += ["<div class=end>End <b>of</b> it</div>"] * (rng.random() < 0.95)
        return "<body>" + "".join(parts)

    order = in_order(spark, 300)
    pages = [(i, f"http://{'ab'[i % 2]}.example/", page(i)) for i in range(300)]
    pages += [pages[k] for k in range(0, 300, 7)] + [(None, "http://a.example/", pages[0][2]), (301, "http://c.example/", "<p>one"), (302, "http://c.example/", None)]
    df = spark.createDataFrame(pages, SCHEMA).repartition(4)
    got = {r["host"]: json.loads(r["wrapper"]) for r in wrapper.wrappers(df).where("layout is null").collect()}
    assert sorted(got) == ["a.example", "b.example"]
    for k, host in enumerate(sorted(got)):
        different = {}
        for i in order:
            if i % 2 == k:
                root = parse(pages[i][2])
                different.setdefault(wrapper._text(root), root)
        first = next(iter(different.values()))
        seen = collections.defaultdict(list)
        for root in different.values():
            partners = {id(b): id(a) for a, b in wrapper.match(first, root)[1]}
            blocks = [(partners.get(id(n)), path, wrapper._text(n), inside) for path, n, inside, _ in wrapper._paths(root)
                      if n.tag in wrapper.BLOCK and n.tag != "body" and wrapper._text(n)]
            for place, path, text, inside in {(p or path, path, text, inside) for p, path, text, inside in blocks}:
                seen[place, path, inside].append(text)
        want = set()
        for (_, path, inside), found in seen.items():
            text, n = collections.Counter(found).most_common(1)[0]
            if n >= 0.8 * len(different):
                want.add((wrapper._place(path, inside), wrapper._code(text)))
        assert {tuple(c) for c in got[host]["constant"]} == want and len(want) >= 2
        assert got[host]["slot"] == "/body/article"


def test_match_is_the_largest():
    """Against a table of all children; what is equal at both ends is matched as it stands, so roots here differ there."""
    rng = random.Random(3)

    def tree(depth, edge=None):
        node = Node(rng.choice(["div", "p", "ul"]) if depth else "div")
        if depth < 2:
            node.children = [tree(depth + 1) for _ in range(rng.randrange(8 - 3 * depth))]
        if edge:
            node.children = [Node(edge), *node.children, Node(edge)]
        return node

    def most(a, b):
        if a.label != b.label:
            return 0
        best = collections.defaultdict(int)
        for (i, x), (j, y) in itertools.product(enumerate(a.children), enumerate(b.children)):
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + most(x, y))
        return 1 + max(best.values(), default=0)

    for _ in range(200):
        a, b = tree(0, "h1"), tree(0, "h2")
        for node in (*a.children, *b.children):  # no inner ends that are equal
            node.children = node.children[:1]
        total, pairs = wrapper.match(a, b)
        assert total == most(a, b) == len(pairs) == len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs})
        assert all(x.label == y.label for x, y in pairs)
