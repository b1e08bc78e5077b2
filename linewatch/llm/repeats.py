"""Substring deduplication by hashing lines and the sentences in them.

Units: every line that is not blank, however short, and in longer lines each run of whole sentences that first
reaches ``MIN_WORDS`` words (white space after them included), so that units meet
again after any longer sentence wherever a shared passage begins. Beside them passages,
which overlap: the ``RUN`` words from each anchor on, over lines and sentences alike.
Anchors are words whose hash with the next word is the least of some ``WINDOW`` in a row, so they
depend on nearby words only and every shared passage of ``WINDOW + RUN`` words holds a whole
run; as ``RUN`` is no less than ``WINDOW``, runs leave no gap, and up to ``WINDOW`` words at either end may stay. Chinese and Japanese characters count as words there. Units are normalised
(case, white space), hashed to 96 bits, and grouped over the whole corpus. The
earliest occurrence by doc_id and offset stays, all others go. A passage that overlaps its own first occurrence
stays. Offsets are code points of the text as it came in.

Digests are written one row a document. Only the first 64 bits of every digest are shuffled and counted, partially before the
shuffle, so a line in a third of all documents is one row a task there. Only digests that occur again are joined back, to
the rows of their units; those get their earliest occurrence by all 96 bits.

Nulls and odd rows: null texts stay null; blank lines stay; empty tables give empty results; null
doc_ids rank last; rows that share a doc_id, or have none, rank by a hash of their text; rows that repeat one
another in doc_id and text rank equal, so both keep a unit where they come first; other columns are passed on as they are, but one named ``removed`` is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import emptied, stored

MIN_WORDS = 10
#: All shared passages of 24 + 26 words hold a run.
WINDOW = 24
RUN = 26
_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_WORD = re.compile(rf"[{_CJK}]|[^\s{_CJK}]+")
_BREAK = re.compile(r"\n|(?<=[.!?])[ \t]+")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int]]:
    """Start, end and number of words of each unit; together they are the whole text."""
    return ((a, b, words) for a, b, words, _ in _units(text, min_words))


def _units(text: str, min_words: int) -> Iterator[tuple[int, int, int, bool]]:
    """Units and whether each is a whole line."""
    start = last = words = 0
    fresh = True  # the unit starts where a line starts
    for m in _BREAK.finditer(text):
        words += len(text[last:m.start()].split())
        last = m.end()
        ends = m.group() == "\n"
        if words >= min_words or ends:
            yield start, last, words, fresh and ends
            start, words, fresh = last, 0, ends
    if start < len(text):
        yield start, len(text), words + len(text[last:].split()), fresh


def digest(unit: str) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(unit.lower().split()).encode("utf-8", "surrogatepass"))


def passages(text: str) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Start, end and digest of the run from each anchor."""
    found = [m.span() for m in _WORD.finditer(text)]
    if len(found) < RUN:
        return np.empty(0, np.int64), np.empty(0, np.int64), []
    hashes = np.array([xxhash.xxh3_64_intdigest(text[a:b].lower().encode("utf-8", "surrogatepass")) for a, b in found], np.uint64)
    mixed = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + (hashes[1:] ^ hashes[1:] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    windows = np.lib.stride_tricks.sliding_window_view(mixed, min(WINDOW, len(mixed)))
    anchors = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    first = anchors[anchors + RUN <= len(found)]
    spans = np.array(found, np.int64)
    raw = hashes.tobytes()
    return spans[first, 0], spans[first + RUN - 1, 1], [xxhash.xxh3_128_digest(raw[8 * a:8 * (a + RUN)]) for a in first.tolist()]


def occurrences(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Units and passages of each document: doc_id, copy (hash of the text), and arrays of where each starts and
    ends, and of its digest in a half of 64 bits and a rest of 32."""
    fields = [("doc_id", pa.int64()), ("copy", pa.int64()), ("start", pa.list_(pa.int32())), ("end", pa.list_(pa.int32())),
              ("half", pa.list_(pa.int64())), ("rest", pa.list_(pa.int32()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, digests, counts = [], [], [], [0]
            for text in batch.column(2):
                text = text.as_py() or ""
                found = [(a, b) for a, b, words, line in _units(text, min_words) if words >= min_words or line and words]
                begins, stops, hashed = passages(text)
                digests += [digest(text[a:b]) for a, b in found]
                digests += hashed
                spans = np.array(found, np.int32).reshape(-1, 2)
                starts += (spans[:, 0], begins.astype(np.int32))
                ends += (spans[:, 1], stops.astype(np.int32))
                counts.append(counts[-1] + len(found) + len(hashed))
            words = np.frombuffer(b"".join(digests), np.int32).reshape(-1, 4)
            half = np.ascontiguousarray(words[:, :2]).view(np.int64).ravel()
            offsets = pa.array(counts, pa.int32())
            whole = (np.concatenate(starts), np.concatenate(ends), half, words[:, 2].copy()) if starts else (np.empty(0, np.int32),) * 4
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v, t.value_type)) for v, (_, t) in zip(whole, fields[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], [name for name, _ in fields])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").mapInArrow(
        run, "doc_id long, copy long, start array<int>, end array<int>, half array<long>, rest array<int>")


def _joined(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    """Sorted spans, those that overlap or touch as one."""
    joined: list[dict[str, int]] = []
    for span in spans:
        if joined and span["start"] <= joined[-1]["end"]:
            joined[-1]["end"] = max(joined[-1]["end"], span["end"])
        else:
            joined.append(dict(span))
    return joined


def deduplicated(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents with ``text`` less its repeated units, ``removed`` (start and end of
    each removed stretch in the text that came in) and all other columns."""
    documents = documents.drop("removed")
    found = stored(occurrences(documents, min_words), "units")
    again = stored(found.select(F.explode("half").alias("half")).groupBy("half").count().where("count > 1").select("half"), "again")
    place = F.shiftleft(F.col("u.start").cast("long"), 32) + F.col("u.end")  # fewer fields, smaller rows
    each = found.select("doc_id", "copy", F.explode(F.arrays_zip("start", "end", "half", "rest")).alias("u")).select(
        "doc_id", "copy", place.alias("place"), F.col("u.half").alias("half"), F.col("u.rest").alias("rest"))
    met = stored(each.join(again, "half", "left_semi"), "met")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "copy", "place")
    repeated = stored(met.groupBy("half", "rest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
                      .where("n > 1").select("half", "rest", "first"), "repeated")  # stored, so that a hot unit's join can be split
    emptied(found, again)
    low = F.lit(0xFFFFFFFF)
    start, end = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(low).cast("int")
    first_end = F.col("first.place").bitwiseAND(low)
    overlaps = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")) & (start < first_end)
    gone = (met.join(repeated, ["half", "rest"]).where((rank > F.col("first")) & ~overlaps)
            .select("doc_id", "copy", start.alias("start"), end.alias("end")))
    spans = (gone.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("removed"))
             .select(F.col("doc_id").alias("_span_doc"), F.col("copy").alias("_span_copy"), "removed"))
    joined = documents.join(spans, F.col("doc_id").eqNullSafe(F.col("_span_doc")) & (
        F.xxhash64("text") == F.col("_span_copy")), "left")
    columns = documents.columns
    rows = joined.select(*[F.col(f"`{c}`") for c in columns],
                         F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"))
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, merged = [], []
            for text, removed in zip(batch.column(at), batch.column(len(columns)), strict=True):
                text, removed = text.as_py(), _joined(removed.as_py())
                merged.append(removed)
                if removed:
                    kept, last = [], 0
                    for span in removed:
                        kept.append(text[last:span["start"]])
                        last = span["end"]
                    text = "".join(kept) + text[last:]
                texts.append(text)
            arrays = list(batch.columns)
            arrays[at] = pa.array(texts, pa.string())
            arrays[-1] = pa.array(merged, batch.schema.types[-1])
            yield pa.RecordBatch.from_arrays(arrays, [*columns, "removed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema)
