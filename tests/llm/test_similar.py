"""The exact search for similar texts: crowds of texts that are not similar, and texts that are not written again."""

import itertools
import random

import numpy as np

import corpus_pipeline
from linewatch.llm import similar


def crowd(n: int, words: int, changed: int) -> list[str]:
    """Texts of one base with words changed at random places."""
    rng, base = random.Random(7), [f"w{i}" for i in range(words)]
    texts = []
    for k in range(n):
        text = list(base)
        for i in rng.sample(range(words), changed):
            text[i] = f"x{k}y{i}"
        texts.append(" ".join(text))
    return texts


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    common = len(np.intersect1d(x, y))
    return common / (len(x) + len(y) - common)


def test_parities_keep_all_similar_pairs():
    sets = [similar.shingle_set(t, 5) for changed in (0, 1, 3, 6, 12) for t in crowd(12, 150, changed)]
    held = [similar._parities(s) for s in sets]
    close = far = 0
    for i, j in itertools.combinations(range(len(sets)), 2):
        differ = sum(int(v).bit_count() for v in (held[i] ^ held[j]).view(np.uint64))
        passes = 9 * differ <= len(sets[i]) + len(sets[j])
        if jaccard(sets[i], sets[j]) >= 0.8:
            assert passes
            close += 1
        else:
            far += not passes
    assert close > 100 and far > 100


def test_crowd_that_is_not_similar_makes_few_pairs(spark, monkeypatch):
    """Sixty texts of one base, at similarities of about 0.6: every two share many shingles, none are linked."""
    texts, made = crowd(60, 200, 6), []
    write = similar.stored

    def stored(df, label):
        out = write(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(similar, "stored", stored)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = similar.similar(docs, 5, keep=("doc_id",)).collect()
    sets = [similar.shingle_set(t, 5) for t in texts]
    linked = [(i, j) for i, j in itertools.combinations(range(60), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    component = {r["doc_id"]: r["component"] for r in rows}
    assert len(component) == 60 and all(component[i] == component[j] for i, j in linked)
    assert len(set(component.values())) > 50
    assert made[1] < 60 * 59 // 2 // 5


def test_only_rows_among_take_part(spark):
    base = [f"w{i}" for i in range(200)]
    ends = [[*base[:199 - k], *(f"z{k}{i}" for i in range(k + 1))] for k in range(3)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate([*ends, ends[0]])], "doc_id long, text string")
    found = similar.similar(docs, 5, keep=("doc_id",), among=docs.where("doc_id <> 1").select("doc_id")).collect()
    assert sorted(r["doc_id"] for r in found) == [0, 2, 3] and len({r["component"] for r in found}) == 1


def test_near_duplicate_stage_does_not_write_texts_on_the_way(spark, monkeypatch):
    written = []
    for module in (corpus_pipeline, similar, corpus_pipeline.simhash):
        write = module.stored
        monkeypatch.setattr(module, "stored", lambda df, label, write=write: written.append(df.columns) or write(df, label))
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(crowd(20, 100, 2))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.one_of_a_kind(spark, docs, "").count() >= 1
    assert written and not any("text" in columns for columns in written)
