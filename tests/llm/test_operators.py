"""The training-data operators against plain Python, with odd rows and empty tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewatch.llm import licences, mixing, multiset, packing, queries, repeats, similar, simhash, token_store, tokens, topk, toxicity, wrapper
from linewatch.llm.common import ranked_before, scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, removed string, size long, bin string"
LINE = "one two three four five six seven eight nine ten eleven twelve"


def odd_rows():
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    texts = ["", None, LINE, LINE + ".\nother end here", f"start of mine\n{LINE}\ntail", "   \n\t ", long, LINE, "Ünï cödé ß 中文 字", "a"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 0, "x", 7, "y") for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, "no id at all", None, None, None, None, None, None), (3, "same id, other text", "en", "s1", 0, "", 0, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_equal_the_tokenizer(monkeypatch):
    enc = tokens.Encoder(queries.tokenizer())
    texts = [r[1] for r in odd_rows()] + ["a\x1fb", "<|ENDOFTEXT|> <|endoftext|>x", "ΑΣ ΣΑΣ don't I'LL 12ab x́", "it's.. ,!"]
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [enc.encode(t).tolist() for t in texts] == want
    monkeypatch.setattr(tokens, "STRETCH", 64)
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    assert [enc.encode(t).tolist() for t in texts] == want


def test_token_files(spark, docs, nothing):
    path = scratch(spark, "t")
    token_store.write(docs, path, queries.tokenizer())
    enc = tokens.encoder(queries.tokenizer())
    ids = sorted([[-1 if r[0] is None else r[0], *enc.encode(r[1]).tolist(), 2] for r in odd_rows()])
    back = sorted([[-1 if r[0] is None else r[0], *r[1]] for r in token_store.read_ids(spark, path).collect()])
    assert back == ids
    rows = sorted(token_store.digests(spark, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in rows] == sorted([r[0] for r in odd_rows()], key=lambda i: -1 if i is None else i)
    one = spark.read.parquet(f"{path}/index.parquet").where("doc_id = 4")
    assert [-1, *token_store.read_ids(spark, path, one).first()["ids"]][1:] == [*enc.encode(odd_rows()[4][1]).tolist(), 2]
    empty = scratch(spark, "t")
    token_store.write(nothing, empty, queries.tokenizer())
    assert token_store.digests(spark, empty).count() == 0


def test_packing(spark, docs, nothing):
    rows = packing.pack_documents(docs, queries.tokenizer()).collect()
    enc = tokens.encoder(queries.tokenizer())
    want = collections.Counter()
    for r in odd_rows():
        ids = [*enc.encode(r[1]).tolist(), 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want[r[0], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.pack_documents(nothing, queries.tokenizer()).count() == 0


@pytest.mark.parametrize(("parts", "group_rows"), [(1, 500_000), (7, 500_000), (40, 500_000), (40, 300)])
def test_packing_is_tight(spark, parts, group_rows):
    sizes = np.random.default_rng(parts).integers(1, 4097, 3000).tolist() + [4096] * 5 + [1] * 50
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(parts)
    rows = packing.pack(items, group_rows=group_rows).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for found in by.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) == len(sizes)
    assert len(by) <= packing.best_fit(np.array(sizes), 4096)[2] * 1.02 + parts


def test_simhash_against_all_pairs(spark, docs, nothing):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 30)]
    fps = set(base)
    for b in base[:6]:  # crowds that share a segment, chains, and far ones
        for _ in range(120):
            f = b
            for k in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                f ^= -2**63 if k == 63 else 1 << int(k)
            fps.add(f)
    for k in range(40):
        fps.add(base[7] ^ (k * 3 << 33))
        fps.add(base[8] ^ (k * 3))
    fps = sorted(fps)
    from linewatch.llm.components import components
    roots = {r["node"]: r["root"] for r in components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))).collect()}
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}
    found = simhash.near_duplicates(docs, 3).collect()
    zero = [r["doc_id"] for r in found if r["fp"] == 0]
    assert sorted(zero) == [0, 1, 5] and {r["component_id"] for r in found if r["fp"] == 0} == {0}
    assert len(found) == len(odd_rows())
    assert simhash.near_duplicates(nothing, 3).count() == 0 and similar.similar(nothing).count() == 0


def test_similar_pairs_meet_beside_strangers(spark):
    """Among unrelated texts near copies meet."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(7):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    found = similar.similar(spark.createDataFrame(rows, "doc_id long, text string"), keep=("doc_id",)).collect()
    groups = collections.defaultdict(set)
    for r in found:
        groups[r["component"]].add(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[2 * i, 2 * i + 1] for i in range(7)]


def test_similar_links_every_pair_at_its_limit(spark, monkeypatch):
    """Isolated pairs just above and below 0.8, and strangers that share most of their
    shingles in one crowd, give the components of all pairs compared."""
    monkeypatch.setattr(similar, "BLOCK", 16)
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = [""]
    for i in range(120):  # a changed tail of k words leaves n - 4 - k shingles of n - 4
        n = int(rng.integers(60, 400))
        words, k = fresh(n), int((n - 4) * rng.uniform(0.08, 0.14))
        texts += [" ".join(words), " ".join([*words[:n - k], *fresh(k)])]
    shared = fresh(140)
    for i in range(60):
        own = fresh(60)
        texts += [" ".join([*shared, *own]), " ".join([*shared, *own[:-15], *fresh(15)])]
    texts += [" ".join([*shared, *fresh(int(rng.integers(10, 40)))]) for _ in range(60)]
    sets = [set(similar.shingle_set(t, 5).tolist()) for t in texts]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[a] if g == group[b] else g for g in group]
    found = similar.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), keep=("doc_id",)).collect()
    parts = lambda named: sorted(sorted(d for d, g in named if g == h) for h in {g for _, g in named})
    assert len(found) == len(texts) and parts([(r["doc_id"], r["component"]) for r in found]) == parts(list(enumerate(group)))


def test_fingerprint_bits(monkeypatch):
    import xxhash
    text = "A b\tC d\x0be " * 40 + "É x"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), seed=42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 3) % (1 << 64) == want
    monkeypatch.setattr(simhash, "STRETCH", 7)
    assert simhash.fingerprint(text, 3) % (1 << 64) == want


def test_repeats(docs, nothing):
    found = repeats.deduplicated(docs)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "bin", "removed"]
    rows = found.collect()
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r["doc_id"]].append(r["text"])
    assert texts[2] == [LINE, LINE]  # repeated rows rank equal
    assert texts[4] == ["start of mine\ntail"] and texts[7] == [""] and texts[1] == [None]
    assert sorted(texts[3]) == sorted([LINE + ".\nother end here", "same id, other text"])  # a full stop makes another unit
    spans = {r["doc_id"]: r["removed"] for r in rows}
    assert [odd_rows()[4][1][s["start"]:s["end"]] for s in spans[4]] == [LINE + "\n"]
    assert repeats.deduplicated(nothing).count() == 0
    for text in [r[1] or "" for r in odd_rows()] + ["A b. C d! e\n\n f.  \n g", "..... a " * 5]:
        for n in (1, 3, 10):
            assert "".join(text[a:b] for a, b, _ in repeats.units(text, n)) == text


def test_repeated_passages_in_any_layout(spark):
    """Short lines, short sentences out of step, unpunctuated and unspaced text: at most the ends of a shared passage stay."""
    rng = np.random.default_rng(3)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    a, b, c = fresh(80), fresh(72), fresh(120)
    lines = "\n".join(" ".join(a[k:k + 8]) for k in range(0, 80, 8))
    sentences = " ".join(" ".join(b[k:k + 6]) + "." for k in range(0, 72, 6))
    han = "".join(chr(0x4E00 + x) for x in rng.integers(0, 8000, 120))
    rows = [f"{' '.join(fresh(9))}\n{lines}\n{' '.join(fresh(5))}", f"{' '.join(fresh(7))}\n{lines}", sentences, " ".join(fresh(7)) + ". " + sentences,
            " ".join([*fresh(30), *c, *fresh(30)]), " ".join([*fresh(41), *c, *fresh(20)]), "".join(["一二三", han]), "".join(["四五六七", han, "八"])]
    found = {r["doc_id"]: r for r in repeats.deduplicated(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    for k, words in ((0, a), (2, [w for w in sentences.split()]), (4, c), (6, list(han))):
        assert found[k]["text"] == rows[k]
        left = sum(w in (found[k + 1]["text"] if k == 6 else found[k + 1]["text"].split()) for w in words)
        assert left <= 2 * repeats.WINDOW and len(rows[k + 1]) - len(found[k + 1]["text"]) == sum(s["end"] - s["start"] for s in found[k + 1]["removed"])


def test_mixing(docs, nothing):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(odd_rows())
    size = lambda t: len((t or "").encode().split())
    assert sum(r["size"] for r in rows) == sum(size(r[1]) for r in odd_rows())
    assert all(0 <= r["copies"] <= 2 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        taken, target = sum(r["size"] * r["copies"] for r in own), own[0]["target"]
        assert abs(taken - target) <= max(r["size"] for r in own) / 2 + 1e-6 and target <= 2 * own[0]["source_size"]
    again = mixing.mixed(docs.repartition(5)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"], r["copies"])
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    assert mixing.mixed(nothing).count() == 0


def test_multiset(docs, nothing):
    rows = multiset.edited(docs).collect()
    assert len(rows) == len(odd_rows())
    order = sorted({(r[0], r[1] or "") for r in odd_rows() if r[0] not in (3,)}, key=lambda x: -1 if x[0] is None else x[0], reverse=True)
    for (i, text), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        if i == 4 or i is not None and i + 1 == 4 or following.startswith("same") or i in (3, 4):
            continue  # next to the id that has two texts
        n = len(text) // 3
        want = hashlib.sha256((text[:len(text) - n] + following[:n]).encode()).hexdigest()
        assert want in {r["edited_sha256"] for r in rows if r["doc_id"] == i}
    assert multiset.edited(nothing).count() == 0


def test_multiset_is_homomorphic(spark):
    texts = {"ab": "first par here\nsecond one", "ba": "second one\n\nfirst par here", "a": "first par here", "b": "second one", "": ""}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    f = {r["doc_id"]: r["f"] for r in multiset.fingerprints(df).collect()}
    assert f[0] == f[1] != f[2]
    both = multiset.fingerprints(df.where("doc_id = 2")).select(F.col("f").alias("x")).crossJoin(
        multiset.fingerprints(df.where("doc_id = 3")).select(F.col("f").alias("y")))
    plus = both.select(multiset.inserted(F.col("x"), F.col("y")).alias("s"), "x", "y")
    got = plus.select("s", multiset.deleted(F.col("s"), F.col("y")).alias("d"), "x", multiset.likeness(F.col("s"), F.col("s")).alias("same")).first()
    assert got["s"] == f[0] and got["d"] == got["x"] and got["same"] == 1.0


def test_ranked_before(spark):
    rows = [(i * 7 % 101,) for i in range(101)] + [(None,)]
    got = ranked_before(spark.createDataFrame(rows, "k long").repartition(4), ["k"], ["k"], wrap=True).collect()
    assert {r["k"]: r["before"]["k"] for r in got} == {**{i: i + 1 for i in range(100)}, 100: None, None: 0}


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(300)]
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([*rng.choice(words, 60), *["zgrok" + str(rng.choice(words)) for _ in range(3 * bad)]])))
        marks += [(i, int(bad)), (i, None)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1)], "doc_id long, toxic int").where(toxicity.learnable(F.col("doc_id")))
    model = toxicity.fit(texts, labels)
    held = {r["doc_id"]: r["score"] for r in toxicity.scored(texts, model, ["doc_id"]).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([(s >= 0.5) == (i % 4 == 0) for i, s in held.items()]) > 0.95
    scored = toxicity.scored(docs, model, docs.columns).collect()
    assert len(scored) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.scored(nothing, model, ["doc_id"]).count() == 0
    blank = toxicity.fit(texts, labels.where("false"))
    assert {round(r["score"], 6) for r in toxicity.scored(docs, blank, ["doc_id"]).collect()} == {0.5}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(700, 12)) / 4).astype(np.float32).tolist()
    v[50] = v[51] = v[100]
    rows = [(i, x, 0) for i, x in enumerate(v)]
    odd = [(700, None, 0), (701, [None] * 12, 0), (702, [float("nan")] * 12, 0), (None, v[0], 0), (3, v[3], 9), (703, [], 0), (800, [0.5, 0.5], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 100 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    m = {i: np.floor(1024 * np.array(x, float)).astype(int) for i, x, _ in rows} | {800: np.array([512, 512] + [0] * 10)}
    want = {q: [(k + 1, i, -s) for k, (s, i) in enumerate(sorted((-int(m[q] @ m[i]), i) for i in m if i != q)[:10])] for q in m if q % 100 == 0}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert topk.search(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_stops_on_proof_only():
    import pandas as pd
    rng = np.random.default_rng(2)
    m = np.concatenate([rng.integers(-50, 50, (500, 6)), np.tile(rng.integers(-50, 50, (1, 6)), (300, 1))])
    ids = np.arange(len(m))
    rows = [(0, -1, ids.tobytes(), b"")]
    for d in range(6):
        o = np.argsort(-m[:, d], kind="stable")
        rows.append((0, d, o.astype(np.int32).tobytes(), m[o, d].tobytes()))
    block = topk.Block(pd.DataFrame(rows, columns=["block", "dim", "ids", "values"]), 6)
    for q in (0, 3, 499, 600, 799):
        want = sorted((-int(m[q] @ m[i]), i) for i in ids if i != q)[:10]
        found, scores = block.top(m[q], q, 10)
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want


def page(i, body, ad):
    return (f"<html><head><title>t</title><script>x('</p>')</script></head><body class=post><header><h2>Site</h2></header><nav><a href=/>Home</a></nav>"
            f"<div class='sidebar-left'>{ad}</div><p>Fixed words of the site</p><div id=main-story><h1>Title {i}</h1><p>{body}<br>more &amp; &eacute;<p>End <b>b</b>old {i}"
            f"</div><section class=comments><p>I disagree {i}</p></section><form><p>Sign up</p></form><footer>(c)</footer></body>")


def test_main_text(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    pages = [(i, f"http://h.example/{i}", page(i, " ".join(words[(i + k) % 8] + str(i) for k in range(30)), f"ad {i}"), "x") for i in range(5)]
    odd = [(10, None, None, "x"), (11, "", "", "x"), (12, "nohost", "<p>a<p>b  c", "x"), (None, "http://h.example/0", pages[0][2], "x"), pages[1],
           (13, "http://z/", "<article><h1>A</h1><nav>n</nav><p>x&nbsp;y<aside>q</aside></article><article>B</article><p>out", "x"), (14, "", "<" * 2000, "x")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string, text string").repartition(2)
    got = collections.defaultdict(list)
    for r in wrapper.extracted(df).collect():
        got[r["page_id"]].append(r["text"])
    for i in range(5):
        body = " ".join(words[(i + k) % 8] + str(i) for k in range(30))
        assert got[i][0] == f"Title {i}\n{body} more & é\nEnd bold {i}"
    assert got[None] == [got[0][0]] and len(got[1]) == 2
    assert got[10] == [""] and got[11] == [""] and got[12] == ["a\nb c"] and got[13] == ["A\nx y\nB"]
    assert wrapper.extracted(df.where("false")).count() == 0


@pytest.mark.parametrize(("html", "want"), [
    ("<body><form id=aspnetForm><div><article><p>Own words here</p></article></div><input name=q><label>Mail</label></form>", "Own words here"),
    ("<div class=page-with-sidebar><article><p>Own words here</p></article><div class=sidebar>ads</div></div>", "Own words here"),
    ("<div id=wrap class=has-header><header>Site</header><article><p>Own words here</p></article></div>", "Own words here"),
    ("<main><div class=page-with-sidebar><nav>x</nav><article><p>Own words here</p></article></div></main>", "Own words here"),
    ("<article><p>Own words</p><section class=discussion><p>We discuss</p></section></article>", "Own words\nWe discuss"),
    ("<article><p>Own words here</p></article><div class=related-posts><article>a long teaser of other words</article></div>", "Own words here"),
    ("<article><p>Own</p></article><div class=comments-area><article class=comment>longer than the article</article></div>", "Own"),
    ("<article><p>Own words here</p><form><p>Sign up</p></form></article><form><p>Sign up for all of our letters</p></form>", "Own words here"),
])
def test_layout_names_keep_articles(html, want):
    assert wrapper.main_text(html, None) == want


def test_licences(spark):
    files = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.txt", "nothing here"), (3, "a/d/LICENSE", "Released under the MIT License."),
             (4, "a/d/e/f.txt", None), (5, "a/d/g.txt", "words\nmore words\nThis work is licensed under the GNU General Public License, version 3."),
             (6, "h/x.txt", ""), (7, None, "All rights reserved."), (8, "LICENSES", "the and of"), (9, "a/b/c.txt", "the license of the the")]
    df = spark.createDataFrame([(*f, "kept") for f in files], "key long, path string, text string, licence string")
    got = {r["key"]: r for r in licences.scanned(df).collect()}
    assert [(got[k]["licence"], got[k]["inherited_from"]) for k in range(1, 10)] == [
        ("Apache-2.0", None), ("Apache-2.0", "a"), ("MIT", None), ("MIT", "a/d"), ("GPL-3.0", None), (None, None), ("Proprietary", None),
        (None, None), ("Apache-2.0", "a")]
    assert got[5]["own_line"] == 2
    odd = df.drop("key").withColumn("key", F.lit(None).cast("long"))
    again = licences.scanned(odd.unionByName(odd)).groupBy("path", "licence", "own_score").count().collect()
    assert sum(r["count"] for r in again) == 18 and {r["own_score"] for r in again if r["path"] == "a/LICENSE"} == {1.0}
    assert [r["licence"] for r in again if r["path"] == "a/d/LICENSE"] == ["MIT"]
    assert licences.scanned(df.where("false")).count() == 0


def test_licence_texts_headers_and_size(spark):
    """Licence texts, tags, wrapped headers and sentences are found, in a small and in a larger corpus."""
    from pathlib import Path
    texts = Path(licences.__file__).parent / "licence_texts"
    header = [h for h in licences.HEADERS if h[0] == "Apache-2.0"][-1][2]
    wrapped = "\n".join(" * " + header[k:k + 70] for k in range(0, len(header), 70))
    files = [("m/LICENSE", (texts / "MIT.txt").read_text(), "MIT"), ("p/LICENSE", (texts / "Apache-2.0.txt").read_text(), "Apache-2.0"),
             ("g/COPYING", (texts / "GPL-2.0.txt").read_text(), "GPL-2.0"), ("a.c", "// SPDX-License-Identifier: MIT", "MIT"),
             ("b.c", "# SPDX-License-Identifier: (GPL-3.0-or-later OR Apache-2.0)\ncode", "GPL-3.0"), ("z.c", "# SPDX-License-Identifier: Zlib", None),
             ("c.c", f"code\n{wrapped}\nint main", "Apache-2.0"), ("d.c", "Copyright 2024 Acme Inc. All rights reserved.", "Proprietary"),
             ("e.md", "Code is released under the MIT License.", "MIT"), ("f.md", "Licensed under the Apache License, Version 2.0. See LICENSE.", "Apache-2.0"),
             ("h.md", "License", None), ("m/inside.c", "int x;", None)]
    rows = [(p, t) for p, t, _ in files]
    for more in (200, 20_000):
        filler = spark.range(more).selectExpr("concat('x/', id) path", "concat('this code is in the file, see word', id) text")
        got = {r["path"]: r for r in licences.scanned(spark.createDataFrame(rows, "path string, text string").unionByName(filler)).where("path not like 'x/%'").collect()}
        assert {p: got[p]["own_licence"] for p, _, _ in files} == {p: want for p, _, want in files}
        assert got["m/inside.c"]["licence"] == "MIT"


def test_licence_filter_loses_nothing(spark, monkeypatch):
    rows = [(i, f"d/{i}", " ".join(np.random.default_rng(i).choice("the apache license version 2 0 under licensed of gnu mit public".split(), 8))) for i in range(60)]
    df = spark.createDataFrame(rows, "key long, path string, text string")
    n, seen = licences.frequencies(df)
    some = sorted(map(tuple, licences.matched(df, n, seen).collect()))
    monkeypatch.setattr(licences, "distinctive", lambda weights: sorted(weights))
    assert sorted(map(tuple, licences.matched(df, n, seen).collect())) == some
