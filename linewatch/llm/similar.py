"""Groups of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more.

The search is exact. Of two such sets, in whatever common order, the first fifth (and one) of
each have a shingle in common, so only those are indexed; the order puts shingles that are
frequent in a sample last, so that passages many documents share meet nobody. What the indexed parts of two sets share bounds
what the sets share, so most candidates are done without their texts; the others are
verified on whole shingle sets. Before that, pairs of a crowd are sifted by 512 parities of each whole set: every bit in which
two sets differ is a shingle that one of them lacks, and similar sets differ in at most a ninth of their sizes. Entries of a shingle are compared with the least and with the
largest of them, which joins groups of copies in few pairs; afterwards every two that share
a shingle and are still in different components are compared, crowded shingles in blocks, shingles that the same documents have as one. So no
link between components is left out, and pairs within one are not made. A crowd of documents that share an
indexed shingle and stay apart costs the square of its size, in tasks of bounded work.

Equal sets are one node. The result is a stored table, and large tables on the way are emptied as soon as
what reads them is stored. Texts are neither written again nor shuffled: a worker reads ``documents`` and makes the sets of
those texts whose hash may be a candidate's (a bit table of fixed size tells; texts it lets through by chance are dropped after).

Nulls and odd rows: null and blank texts have no shingles and are one node, linked to nothing else; a text of fewer words
than a shingle is one shingle; very long texts are worked through in stretches; repeated rows and copies share a node; ``doc_id`` is not
used, so null and repeated ids do no harm; columns named in ``keep`` are handed on (not ``text``, ``component`` or
names that begin with an underscore), others are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewatch.llm.common import emptied, stored
from linewatch.llm.components import components
from linewatch.llm.simhash import STRETCH

#: Documents whose rarest shingles are looked up, and the most shingles held as frequent.
SAMPLE = 10_000
FREQUENT = 100_000
#: Entries of a crowded shingle that meet in one task.
BLOCK = 512
#: Texts whose shingles a Python worker holds at once.
SLICE = 256
#: Parities kept of a set of shingles, in longs of 64.
PARITIES = 512
#: Bits of the table that tells which texts may be candidates.
LOOKUP = 1 << 23


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles."""
    words = (text or "").encode().lower().split()
    found = [np.empty(0, np.int64)]
    for at in range(0, max(1, len(words) - width + 1), STRETCH) if words else ():
        part = words[at:at + STRETCH + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(part) >= width else [b" ".join(part)]
        found.append(np.unique(np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, shingles)), np.int64)))
    return np.unique(np.concatenate(found))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker's memory does not follow the size of Spark's batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _frequent(documents: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in a sample of the documents, sorted, and how often they do."""
    step = max(1, documents.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), width))], ["shingle"])

    sample = documents.where(F.pmod(F.xxhash64("text"), F.lit(step)) == 0).select("text")
    rows = (sample.mapInArrow(run, "shingle long").groupBy("shingle").count().where("count > 2")
            .orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect())
    found = np.array(sorted((r["shingle"], r["count"]) for r in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _prefix(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first fifth of the shingles, and one more, in an order that is the same for all
    documents: those not known as frequent, then the frequent ones by count."""
    n = len(shingles) // 5 + 1
    if not len(frequent) or not len(shingles):
        return shingles[:n]
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return shingles[np.lexsort((shingles, np.where(frequent[at] == shingles, counts[at], 0)))[:n]]


def _may_match(x: str, y: str) -> Column:
    """Of two entries: can sizes and places still give a Jaccard similarity of 0.8?
    True for the first common shingle of every pair that has it."""
    n, m, i, j = F.col(f"{x}.size"), F.col(f"{y}.size"), F.col(f"{x}.at"), F.col(f"{y}.at")
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - i, m - j) >= 4 * (n + m))


def _parities(shingles: np.ndarray) -> np.ndarray:
    """Of how many shingles fall on each of ``PARITIES`` places: odd or even, packed in longs."""
    return np.packbits((np.bincount(shingles & (PARITIES - 1), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _near(x: str, y: str) -> Column:
    """Of two whole sets: may they differ in so few shingles that their Jaccard similarity is 0.8? True for all that do."""
    differ = sum((F.bit_count(F.col(f"{x}.parities")[k].bitwiseXOR(F.col(f"{y}.parities")[k])) for k in range(PARITIES // 64)), F.lit(0))
    return 9 * differ <= F.col(f"{x}.size") + F.col(f"{y}.size")


def _lookup(keys: DataFrame) -> np.ndarray:
    """A bit for every ``_key``, in longs; different keys may share one."""
    bit = F.pmod("_key", F.lit(LOOKUP).cast("long"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    table = np.zeros(LOOKUP // 64, np.int64)
    for word, bits in keys.groupBy(F.expr(f"pmod(_key, {LOOKUP}L) div 64").alias("word")).agg(F.bit_or(one)).collect():
        table[word] = bits
    return table


def _marked(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    bit = keys % LOOKUP
    return (table[bit >> 6] >> (bit & 63)) & 1 == 1


def _entry(*more: str) -> Column:
    return F.struct("node", "size", "at", "root", *more)


def _once(entries: DataFrame) -> DataFrame:
    """Of the shingles that stand in more than one component, those that the same nodes have (passages) as one: their
    pairs are the same. Each node keeps its least place there; sets that share a number by chance only meet more often."""
    nodes = [F.bit_xor(F.xxhash64("node", F.lit(seed))) for seed in (1, 2)]
    shared = (entries.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.xxhash64(*nodes).alias("crowd"))
              .where("low <> high").select("shingle", "crowd"))
    return (entries.join(shared, "shingle").groupBy(F.col("crowd").alias("shingle"), "node", "size", "root").agg(F.min("at").alias("at")))


def _hub_pairs(entries: DataFrame, hub: Column) -> DataFrame:
    """Each entry of a shingle with one of them; a pair within a component is none."""
    hubs = entries.groupBy("shingle").agg(hub.alias("y"))
    return (entries.select("shingle", _entry().alias("x")).join(hubs, "shingle")
            .where((F.col("x.root") != F.col("y.root")) & _may_match("x", "y")))


def _all_pairs(entries: DataFrame) -> DataFrame:
    """Every two entries of a shingle that are in different components, in blocks of bounded work."""
    sizes = entries.groupBy("shingle").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = entries.join(sizes, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    left = dealt.select("shingle", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), _entry("parities").alias("x"))
    right = dealt.select("shingle", F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("i"), F.col("own").alias("j"), _entry("parities").alias("y"))
    return left.join(right, ["shingle", "i", "j"]).where(
        (F.col("x.root") != F.col("y.root")) & ((F.col("i") < F.col("j")) | (F.col("x.node") < F.col("y.node"))) & _may_match("x", "y") & _near("x", "y"))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes())


def similar(documents: DataFrame, width: int = 5, keep: tuple[str, ...] = (), among: DataFrame | None = None) -> DataFrame:
    """``component`` and the columns ``keep`` per row; see the module. ``among``: only rows whose columns of these
    names (some of ``keep``) are in it take part, so that who calls need not write their texts again."""
    frequent, counts = _frequent(documents, width)
    key = F.xxhash64("text").alias("_key")
    kept = ["_key", *keep]
    rows = documents.select("text", key, *keep)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(t.as_py(), width) for t in batch.column(0)]
            nodes = [_node(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(nodes, pa.uint64()).view(pa.int64()), pa.array(list(map(len, sets)), pa.int64()),
                 pa.array([_prefix(s, frequent, counts) for s in sets], pa.list_(pa.int64())),
                 pa.array([_parities(s) for s in sets], pa.list_(pa.int64()))], [*kept, "_node", "_size", "_prefix", "_parities"])

    def whole(table: np.ndarray):
        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = np.unique(batch.column(1).to_numpy(zero_copy_only=False), return_index=True)
                for part in _slices(iter([batch.take(pa.array(at[_marked(keys, table)]))])):
                    sets = [shingle_set(t.as_py(), width) for t in part.column(0)]
                    yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.uint64()).view(pa.int64()),
                                                      pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])
        return sets_of

    marked = rows.mapInArrow(run, f"{types}, _node long, _size long, _prefix array<long>, _parities array<long>")
    marked = marked if among is None else marked.join(among, among.columns, "left_semi")
    shingled = stored(marked, "shingled")
    nodes = stored(shingled.select(F.col("_node").alias("node"), F.col("_size").alias("size"), "_prefix", "_key",
                                   F.col("_parities").alias("parities")).dropDuplicates(["node"]), "nodes")
    docs = stored(shingled.select("_node", *keep), "members")
    emptied(shingled)
    index = nodes.select("node", "size", F.posexplode("_prefix").alias("at", "shingle"))
    several = index.select("shingle").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    entries = stored(index.join(several, "shingle").withColumn("root", F.col("node")), "entries")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
        x = nodes.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("_prefix").alias("x"))
        y = nodes.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("_prefix").alias("y"))
        # All that two sets share is in both prefixes, or past the end of the one that ends first.
        most = F.size(F.array_intersect("x", "y")) + F.greatest(F.col("n") - F.size("x"), F.col("m") - F.size("y"))
        pairs = stored(pairs.join(x, "a").join(y, "b").where(9 * most >= 4 * (F.col("n") + F.col("m"))).select("a", "b"), "likely")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # a node has one key, a key one text
        table = _lookup(nodes.select("node", "_key").join(ends, "node", "left_semi").select("_key"))
        sets = stored(documents.select("text", key).mapInArrow(whole(table), "node long, shingles array<long>")
                      .dropDuplicates(["node"]).join(ends, "node", "left_semi"), "sets")
        x, y = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        common = 9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))
        found = stored(pairs.join(x, "a").join(y, "b").where(common).select("a", "b"), "verified")
        emptied(sets)
        return found

    links = verified(_hub_pairs(entries, F.min(_entry())).unionByName(_hub_pairs(entries, F.max(_entry()))))
    roots = stored(components(links), "roots")
    named = entries.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = stored(_once(named).join(nodes.select("node", "parities"), "node"), "entries")
    emptied(entries)
    links = links.unionByName(verified(_all_pairs(apart)))
    emptied(apart, nodes)
    roots = stored(components(links), "roots")
    found = stored(docs.join(roots.withColumnRenamed("node", "_node"), "_node", "left")
                   .select(F.coalesce("root", "_node").alias("component"), *keep), "components")
    emptied(docs)
    return found
