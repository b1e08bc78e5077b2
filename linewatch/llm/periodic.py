"""Periodic runs of words in texts, by common extensions from suffix trees.

A run is a stretch of words with smallest period ``q``, at least ``max(LEAST, REPEATS * q)`` long, that no
neighbouring word extends. Words are what stands between white space of ASCII.

Each text is first cut exactly: a word that stands fewer than ``REPEATS`` times in a stretch lies in no run of
that stretch (a run holds each of its words at least so often), so runs, and the neighbours that end them, lie
between such words; that is repeated until nothing is cut. For each stretch left the suffix trees of it and of its
reversal are built (online, in linear time), and the string depths along their Euler tours go into tables of
minima over powers of two, so the longest common extension from two places is one lookup, forward and
backward. For both orders of the words every place has one longest Lyndon word, up to the next smaller suffix; each
run has the period of one of these as its root. Extending all of them both ways gives every run, in a linear
number of lookups.

Documents are dealt as they lie; a document is worked off in one task, its trees take about 1 kB a
word that the cut leaves. There is no shuffle.

Nulls and odd rows: a null text has no words; empty texts and texts of fewer than ``LEAST`` words have no runs;
repeated rows and repeated or null ids all get their rows; an empty table gives an empty result; other columns
are handed on only if named.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 6
REPEATS = 4
RUN = "struct<start: long, length: long, period: long>"


class SuffixTree:
    """Tree of all suffixes of ``text`` (numbers from 1), each ended by a 0 of its own.

    ``extension`` gives common prefixes of suffixes; ``order`` ranks suffixes.
    """

    def __init__(self, text: Sequence[int]) -> None:
        self.text = [*text, 0]
        self.size = max(self.text) + 1
        self._grow()
        self._tour()

    def _grow(self) -> None:
        """Online construction; an edge is kept under parent * size + its first word."""
        text, size = self.text, self.size
        whole = len(text)
        edges: dict[int, int] = {}
        start, end, link = [0], [0], [0]
        node, edge, length, left = 0, 0, 0, 0
        for at, word in enumerate(text):
            inner = 0  # made in this phase and still without a suffix link
            left += 1
            while left:
                if not length:
                    edge = at
                key = node * size + text[edge]
                child = edges.get(key)
                if child is None:
                    edges[key] = len(start)
                    start.append(at)
                    end.append(whole)
                    link.append(0)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    first = start[child]
                    span = end[child] - first
                    if length >= span:
                        edge += span
                        length -= span
                        node = child
                        continue
                    if text[first + length] == word:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(start)
                    start.append(first)
                    end.append(first + length)
                    link.append(0)
                    edges[key] = split
                    start[child] = first + length
                    edges[split * size + text[first + length]] = child
                    edges[split * size + word] = split + 1
                    start.append(at)
                    end.append(whole)
                    link.append(0)
                    if inner:
                        link[inner] = split
                    inner = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - left + 1
        self.spans = [e - s for s, e in zip(start, end, strict=True)]
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        nodes = np.fromiter(edges.values(), np.int64, len(edges))
        by_parent = np.argsort(keys, kind="stable")
        keys = keys[by_parent]
        self.children = nodes[by_parent].tolist()
        self.ended = (keys % size == 0).tolist()  # the child by the end mark, if any, comes first
        self.begins = np.searchsorted(keys // size, np.arange(len(start) + 1)).tolist()

    def _tour(self) -> None:
        """String depths along the Euler tour, and where each suffix stands in it."""
        whole, children, begins, spans = len(self.text), self.children, self.begins, self.spans
        place = [0] * whole
        depths, depth = [0], [0] * len(spans)
        due, path = begins[:], [0]
        while path:
            node = path[-1]
            child_at = due[node]
            if child_at < begins[node + 1]:
                due[node] = child_at + 1
                child = children[child_at]
                down = depth[node] + spans[child]
                if begins[child] == begins[child + 1]:
                    place[whole - down] = len(depths)
                    depths += (down, depth[node])
                else:
                    depth[child] = down
                    depths.append(down)
                    path.append(child)
            else:
                path.pop()
                if path:
                    depths.append(depth[path[-1]])
        self.place = np.array(place)
        self.depth = depth
        table = [np.array(depths, np.int32)]
        while 2 << len(table) - 1 <= len(depths):
            last, half = table[-1], 1 << len(table) - 1
            table.append(np.minimum(last[:-half], last[half:]))
        self.least = table

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes ``a`` and ``b`` (different places): the
        string depth of their lowest common ancestor, the least on the tour between them."""
        low, high = np.minimum(self.place[a], self.place[b]), np.maximum(self.place[a], self.place[b])
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), np.int64)
        for n in np.unique(level).tolist():
            here = level == n
            row = self.least[n]
            out[here] = np.minimum(row[low[here]], row[high[here] - (1 << n) + 1])
        return out

    def order(self, falling: bool) -> np.ndarray:
        """Rank of each suffix with words rising or ``falling``; a prefix ranks first in both."""
        whole, children, begins, spans = len(self.text), self.children, self.begins, self.spans
        if not falling:
            return np.argsort(np.argsort(self.place))
        rank, found, stack = [0] * whole, 0, [(0, 0)]
        while stack:
            node, down = stack.pop()
            a, b = begins[node], begins[node + 1]
            if a == b:
                rank[whole - down] = found
                found += 1
                continue
            ended = self.ended[a]
            stack += [(c, down + spans[c]) for c in children[a + ended:b]]  # the greatest word is popped first
            if ended:
                stack.append((children[a], down + spans[children[a]]))
        return np.array(rank)


def next_smaller(rank: Sequence[int]) -> np.ndarray:
    """For each place the next one of smaller rank; the last place has the smallest."""
    out, stack = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out)


def stretches(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int]]:
    """Stretches (begin, end) in which every word stands ``repeats`` times or more."""
    at, part = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(at) >= least:
        _, word, count = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = count[word] >= repeats
        kept = at[often]
        if not len(kept):
            return []
        part = np.cumsum(np.concatenate([[0], np.diff(kept) > 1]))
        long = np.bincount(part)[part] >= least
        at, part = kept[long], part[long]
        if often.all() and long.all():
            ends = np.flatnonzero(np.diff(at) > 1)
            return list(zip(at[np.concatenate([[0], ends + 1])].tolist(), (at[np.concatenate([ends, [len(at) - 1]])] + 1).tolist(), strict=True))
    return []


def runs_between(text: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch."""
    n = len(text)
    text = (np.unique(text, return_inverse=True)[1] + 1).tolist()
    ahead, back = SuffixTree(text), SuffixTree(text[::-1])
    found: set[tuple[int, int, int]] = set()
    for falling in (False, True):
        root = np.arange(n)
        after = next_smaller(ahead.order(falling).tolist())[:n]
        period = after - root
        short = period * repeats <= n
        root, after, period = root[short], after[short], period[short]
        right = ahead.extension(root, after)
        left = np.zeros(len(root), np.int64)
        inner = root > 0
        left[inner] = back.extension(n - root[inner], n - after[inner])  # of the words before the two places
        length = left + period + right
        long = length >= np.maximum(least, repeats * period)
        found.update(zip((root - left)[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True))
    return sorted(found)


def runs_of(words: Sequence, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a list of words, by start, then period."""
    if len(words) < least:
        return []
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = [(a + s, length, q) for a, b in stretches(ids, least, repeats) for s, length, q in runs_between(ids[a:b], least, repeats)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def found(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``runs`` (array of start, length, period, by start and period) and
    ``collapsed`` (the text without the repeats) of each row."""
    keep = list(keep)
    kept = docs.select(*keep, docs[text].alias("_text"))
    schema = ", ".join(f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in keep)
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for value in batch.column(len(keep)):
                words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()
                runs = runs_of(words)
                rows.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                texts.append(collapsed(words, runs).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(rows, run), pa.array(texts, pa.string())],
                                             [*keep, "runs", "collapsed"])

    return kept.mapInArrow(work, f"{schema}{', ' if keep else ''}runs array<{RUN}>, collapsed string")
