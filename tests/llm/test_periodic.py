"""Periodic runs against a direct search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from linewatch.llm import periodic, queries
from tests.conftest import TESTDATA


def brute(words, least=6, repeats=4):
    numbers, found = {}, []
    a = np.array([numbers.setdefault(w, len(numbers)) for w in words])
    for q in range(1, len(a) // repeats + 1):
        same = np.concatenate([[False], a[:-q] == a[q:], [False]])
        turns = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(turns[::2].tolist(), turns[1::2].tolist()):
            length = j - i + q
            part = a[i:i + length]
            if length >= max(least, repeats * q) and not any((part[p:] == part[:-p]).all() for p in range(1, q)):
                found.append((i, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_all_runs_of_random_words():
    chance = random.Random(5)
    for _ in range(1500):
        n, kinds = chance.randint(0, 60), chance.choice([1, 2, 2, 3, 5])
        words = [chance.randrange(kinds) for _ in range(n)]
        if n and chance.random() < 0.6:
            a = chance.randrange(n)
            p = 1 + chance.randrange((n - a) // 3 + 1)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words += [99, *words[::-1], *words] if chance.random() < 0.5 else []
        assert periodic.runs_of(words) == brute(words)


def test_runs_next_to_each_other_and_nested():
    for words in ("a b " * 4 + "a " * 9 + "b a " * 5, "x " + ("a a a a b " * 5) + "y", "a " * 6, "a " * 5, "a b c " * 4 + "a b"):
        words = words.split()
        assert periodic.runs_of(words) == brute(words)


def test_long_text_is_worked_off_whole():
    words = [f"w{i}" for i in range(50_000)] + ["la", "di", "da"] * 20_000 + ["end"]
    assert periodic.runs_of(words) == [(50_000, 60_000, 3)]
    assert len(periodic.collapsed([w.encode() for w in words], [(50_000, 60_000, 3)]).split()) == 50_004


def test_extensions_and_orders():
    text = [1, 2, 1, 2, 2, 1, 2, 1, 1]
    tree = periodic.SuffixTree(text)
    for a in range(len(text)):
        for b in range(len(text)):
            if a != b:
                common = next((k for k in range(len(text)) if text[a + k:a + k + 1] != text[b + k:b + k + 1] or max(a, b) + k >= len(text)), 0)
                assert tree.extension(np.array([a]), np.array([b]))[0] == common
    for falling in (False, True):
        key = lambda i: [-w if falling else w for w in text[i:]]
        ranked = sorted(range(len(text) + 1), key=key)
        assert [int(r) for r in tree.order(falling)] == [ranked.index(i) for i in range(len(text) + 1)]


def test_query_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet").collect()}
    found = queries.op13_periodic_runs(spark, f"{TESTDATA}/sf0.01").collect()
    assert len(found) == len(docs) and any(r["n_runs"] for r in found)
    for row in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", docs[row["doc_id"]] or "")
        n, h = len(words), zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs, kept = brute(words), [True] * n
        for s, length, q in runs:
            kept[s + q:s + length] = [False] * (length - q)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(" ".join(w for w, k in zip(words, kept) if k).encode()).hexdigest()


@pytest.mark.parametrize("doc_id", [None, 7, 30])
def test_odd_texts(spark, doc_id):
    texts = [None, "", " \t\n", "a", "no break " * 6, "a\x0ba a\na a a", "é " * 8]
    frame = spark.createDataFrame([(doc_id, t, "r", 1) for t in [*texts, *texts]], "doc_id long, text string, runs string, collapsed int")
    rows = periodic.found(queries.with_periodic_tails(frame)).collect()
    assert len(rows) == 14
    got = sorted((r["collapsed"], [tuple(x) for x in r["runs"]]) for r in rows)
    want = [("", []), ("", []), ("", []), ("a", []), ("no break", [(0, 6, 1)]), ("a", [(0, 6, 1)]), ("é", [(0, 8, 1)])]
    assert got == sorted([*want, *want])
    assert periodic.found(frame.limit(0)).count() == 0


def test_keeps_columns_of_clashing_names(spark):
    frame = spark.createDataFrame([(1, "b " * 6, "mine")], "doc_id long, text string, _text string")
    assert periodic.found(frame, keep=("doc_id", "text")).first()["text"] == "b " * 6
    assert periodic.found(frame.select("doc_id", "text"), keep=()).first()["runs"][0]["length"] == 6
