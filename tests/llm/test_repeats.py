"""Repeated lines against a plain line counter."""

from linewatch.llm import repeats
from tests.conftest import TESTDATA


def normal(line):
    return " ".join(line.lower().split())


def test_no_line_is_left_twice(spark):
    """Over a whole table: every line that is not blank is left once at most, and the first one in place."""
    docs = spark.read.parquet(f"{TESTDATA}/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: r for r in repeats.deduplicated(docs).collect()}
    first = {}
    for doc_id in sorted(texts):
        for line in (texts[doc_id] or "").split("\n"):
            first.setdefault(normal(line), doc_id)
    left = {}
    for doc_id in sorted(found):
        text, at = texts[doc_id] or "", 0
        kept = ""
        for span in found[doc_id]["removed"]:  # offsets rebuild the text
            kept, at = kept + text[at:span["start"]], span["end"]
        assert kept + text[at:] == (found[doc_id]["text"] or "")
        begin = 0
        gone = [(s["start"], s["end"]) for s in found[doc_id]["removed"]]
        for line in text.split("\n"):
            if normal(line) and not any(a <= begin and begin + len(line) <= b for a, b in gone):
                untouched = not any(a < begin + len(line) and begin < b for a, b in gone)
                if untouched:
                    left.setdefault(normal(line), []).append(doc_id)
            begin += len(line) + 1
    assert [x for x, ids in left.items() if len(ids) > 1] == []
    assert all(ids[0] == first[x] for x, ids in left.items())


def test_short_lines_and_shared_ids(spark):
    rows = [(1, "Read more\nown words here\n\nread  MORE"), (2, "\nRead more\n \nlast"), (None, "no id\nRead more"), (None, "no id\nother"), (3, "Read"),
            (4, "more"), (5, "same"), (5, "same\nand more")]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in repeats.deduplicated(found).collect())
    texts = [t for _, t in got]
    assert (1, "Read more\nown words here\n\n") in got and (2, "\n \nlast") in got and (3, "Read") in got and (4, "more") in got
    joined = "\n".join(texts)
    assert joined.lower().count("read more") == 1 and joined.count("no id") == 1 and joined.count("same") == 1
