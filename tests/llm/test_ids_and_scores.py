"""Ids against the tokenizer itself, scores of large components against plain whole numbers."""

import random

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from linewatch.llm import queries, tokens, topk
from tests.conftest import TESTDATA

LETTERS = ["abcdefghij", "ABCXYZ", "ıİiIşŞğĞçÇ", "àéîõüÿĀžǅǈ", "αβγΣςσΩ", "абвЖЯ", "中文字", "אבג", "ʼʰ", "̇́", "0123٣", "ßﬁŉ"]
MARKS = [" ", " ", " ", "\n", "\t", ".", ",", "!", "?", ";", ":", "%%%", "&&&", "'", "'s", "'LL", "-", "_", "$", "…", "’", "–", "«", "€", "\x1f", "<|", "<|endoftext|>"]


def test_random_strings_get_the_tokenizers_ids(monkeypatch):
    enc, chance = tokens.Encoder(queries.tokenizer()), random.Random(11)
    monkeypatch.setattr(tokens, "REMEMBERED", 3000)  # generations change many times
    known = ["BELGESİ, dedi ’", "– TÜRKİ.", "İ", "İ.", "Aİ! ж", "ŉ. –", "don't.%%% x", "a_b_ c--"]
    texts = []
    for n in range(20_000):
        kinds = chance.sample(LETTERS, chance.randint(1, 3))
        text = known[n] if n < len(known) else "".join(
            "".join(chance.choices(chance.choice(kinds), k=chance.randint(1, 6))) + "".join(chance.choices(MARKS, k=chance.randint(0, 2)))
            for _ in range(chance.randint(1, 12)))
        texts.append(text)
    for text, ids in zip(texts, enc.encode_all(texts), strict=True):
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_ids_of_a_whole_table():
    enc = tokens.Encoder(queries.tokenizer())
    for text in pq.read_table(f"{TESTDATA}/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def plain_top(rows, k):
    """query_id, rank, vec_id, score of plain whole numbers; every row asks."""
    whole = {i: [int(np.floor(c * 1024)) for c in v] for i, v in rows}
    out = []
    for q, w in whole.items():
        scores = sorted((-min(max(sum(a * b for a, b in zip(w, v)), -2 ** 63), 2 ** 63 - 1), i) for i, v in whole.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_scores_of_large_components(spark):
    for size, seed in ((1e5, 1), (64.0, 2), (3e6, 3)):
        chance = np.random.default_rng(seed)
        rows = [(i, (chance.normal(size=64) * size).tolist()) for i in range(60)]
        rows += [(100 + i, [size] * 63 + [size - 1 + i / 1024]) for i in range(12)]  # differ in the last places only
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = sorted(map(tuple, topk.search(frame, F.lit(True), k=10).collect()))
        assert found == plain_top(rows, 10)
