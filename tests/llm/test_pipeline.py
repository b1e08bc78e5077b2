"""The pipeline's stages and the SQL twins, on the smallest tables."""

import collections
import os

import duckdb
import pytest

import corpus_pipeline
from linewatch.llm import queries
from tests.conftest import TESTDATA

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.load()))
def test_queries(spark, name):
    entry = queries.load()[name]
    df = entry.run(spark, SF)
    rows = df.collect()
    assert rows
    if entry.sql:
        con = duckdb.connect()
        for t in ("documents", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        cur = con.execute(entry.sql)
        names = [c[0] for c in cur.description]
        want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(r[c] for c in sorted(names)) for r in rows) == want


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, SF).write.parquet(os.path.join(folder, name))
        docs = spark.read.parquet(os.path.join(folder, name))
        assert docs.columns == columns
        now = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert {i for i, _ in now} <= set(kept) and now
        if k == 1:  # of equal texts one is left, the earliest
            first = {}
            for i in sorted(kept):
                first.setdefault(kept[i], i)
            texts = collections.Counter(t for _, t in now)
            assert max(texts.values()) == 1 and all(first[t] == i for i, t in now)
        kept = dict(now)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.select("doc_id").distinct().count() == len(kept)


def test_near_duplicate_stage_on_odd_rows(spark):
    rows = [(None, "no id", "en", None, 5), (None, "no id", "en", None, 5), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", None, "t", 1),
            (3, None, None, None, None), (4, "", "x", "y", 0), (5, "other text that is by itself", "en", "s", 9), (5, "and one more that has the same id", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_a_kind(spark, docs, SF).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "3", "5", "5", "None"]
    assert corpus_pipeline.one_of_a_kind(spark, docs.where("false"), SF).count() == 0


def test_near_duplicate_stage_links_by_simhash(spark):
    """Texts of one repeated passage and different ends: equal fingerprints, different sets of shingles."""
    passage = "spam eggs ham " * 200
    rows = [(k, passage + " ".join(f"end{k}x{i}" for i in range(40)), "en", "s", 1) for k in (3, 1, 2)]
    rows.append((4, " ".join(f"other{i}" for i in range(60)), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_a_kind(spark, docs, SF).collect()) == [1, 4]


def test_near_duplicate_stage_links_by_shingles_what_two_bits_do_not(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join([*words[:190], *(f"z{i}" for i in range(10))]), "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.simhash.near_duplicates(docs, width=3).select("component").distinct().count() == 2
    assert [r["doc_id"] for r in corpus_pipeline.one_of_a_kind(spark, docs, SF).collect()] == [1]


def test_shingles_are_held_for_few_texts_at_once():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["n"])
    parts = list(corpus_pipeline.similar._slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 256 and [n for p in parts for n in p.column(0).to_pylist()] == list(range(1000))
