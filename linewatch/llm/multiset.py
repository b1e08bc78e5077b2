"""Document fingerprints by a homomorphic multiset hash over paragraphs.

A paragraph (a line that is not blank) is hashed to a wide vector; the fingerprint is the sum
of the vectors of all paragraphs, lane by lane modulo a power of two. So the order of paragraphs
does not matter, equal multisets are equal, and a paragraph is inserted or deleted by
adding or subtracting its vector (``inserted``, ``deleted``).

The vector has two parts, both functions of the paragraph alone:

* ``LANES`` lanes modulo 2^32, hashed from the whole paragraph (equality);
* 64 lanes that add up the hash bits of the paragraph's adjacent word pairs, modulo 2^31 (likeness).
  Read as signs, the difference of two such sums estimates how many pairs differ, so
  ``likeness`` is near the share of pairs in common (deviation about 1/8).

Built-in functions only. Two likeness lanes share a long while they are added up;
texts meet what replaces their ends by one exchange of the texts, and all sums are made behind it.

Nulls and odd rows: null and empty texts have all lanes zero, and are like each other
(1) and unlike others (0); rows that repeat a doc_id with other texts are documents of
their own, in descending order of text hash; rows equal in both share their next
document; null doc_ids come last; very long texts only need their own row in
memory; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import ranked_before, stored

LANES = 16
SIGNS = 64
_LOW = 0xFFFFFFFF
_HALF = 31  # bits of each of two likeness lanes in a long
_KEY = ["id", "digest"]


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: F.trim(p) != "")


def exact_lanes(text: Column) -> Column:
    """Lanes of the whole paragraphs, an array of ``LANES`` longs below 2^32."""
    marks = F.transform(_paragraphs(text), lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(p, F.lit(1)).alias("b")))
    lane = lambda m, k: F.xxhash64(m["a"], m["b"], F.lit(k)).bitwiseAND(F.lit(_LOW))
    zero = F.array(*[F.lit(0).cast("long")] * LANES)
    return F.aggregate(marks, zero, lambda acc, m: F.zip_with(
        acc, F.array(*[lane(m, k) for k in range(LANES)]), lambda x, y: (x + y).bitwiseAND(F.lit(_LOW))))


def pair_hashes(text: Column) -> Column:
    """Hashes of adjacent words in each paragraph; its ends count as words."""
    words = F.transform(_paragraphs(text), lambda p: F.split(F.trim(p), r"[ \t\r\x0B\x0C]+"))
    return F.flatten(F.transform(words, lambda w: F.zip_with(
        F.concat(F.array(F.lit("")), w), w, lambda a, b: F.xxhash64(a, b))))


def summed(texts: DataFrame, keys: list[str]) -> DataFrame:
    """``n`` (word pairs) and ``ones`` (64 lanes) of the texts of each ``keys``; clustered by
    some of the keys, they are summed without an exchange."""
    rows = texts.select(*keys, pair_hashes(F.col("text")).alias("pairs"))
    lanes = rows.select(*keys, F.explode("pairs").alias("h"))
    bits = lambda k, mask: F.shiftrightunsigned("h", k).bitwiseAND(F.lit(mask))
    two = [F.sum(bits(k, (1 << _HALF) | 1)).alias(f"s{k}") for k in range(_HALF)]  # lanes k and k + 31
    one = [F.sum(bits(k, 1)).alias(f"s{k}") for k in range(2 * _HALF, SIGNS)]
    low = F.lit((1 << _HALF) - 1)
    ones = [F.col(f"s{k}").bitwiseAND(low) for k in range(_HALF)] \
        + [F.shiftrightunsigned(f"s{k}", _HALF).bitwiseAND(low) for k in range(_HALF)] \
        + [F.col(f"s{k}") for k in range(2 * _HALF, SIGNS)]
    return lanes.groupBy(*keys).agg(F.count("*").alias("n"), *two, *one).select(*keys, "n", F.array(*ones).alias("ones"))


def likeness(a: Column, b: Column) -> Column:
    """Of two structs with ``n`` and ``ones``: 1 if equal, near 0 if unrelated."""
    signs = lambda f: F.transform(f["ones"], lambda c: (c * 2 - f["n"]).cast("double"))
    squares = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    apart = squares(F.zip_with(signs(a), signs(b), lambda x, y: x - y))
    size = squares(signs(a)) + squares(signs(b))
    return F.when(size == 0, (a["n"] == b["n"]).cast("double")).otherwise(F.greatest(F.lit(0.0), 1 - apart / size))


def text_form(f: Column) -> Column:
    """A fingerprint as hexadecimal digits: its exact lanes, number of pairs and likeness lanes."""
    digits = lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")
    return F.concat(F.array_join(F.transform(f["exact"], digits), ""), digits(f["n"]),
                    F.array_join(F.transform(f["ones"], digits), ""))


def _combined(f: Column, g: Column, sign: int) -> Column:
    lanes = lambda name, mask: F.zip_with(f[name], g[name], lambda x, y: (x + y * sign).bitwiseAND(F.lit(mask))).alias(name)
    return F.struct(lanes("exact", _LOW), (f["n"] + g["n"] * sign).alias("n"), lanes("ones", (1 << _HALF) - 1))


def inserted(f: Column, paragraph: Column) -> Column:
    """The fingerprint of a document with the paragraphs of ``paragraph`` (a fingerprint) put in."""
    return _combined(f, paragraph, 1)


def deleted(f: Column, paragraph: Column) -> Column:
    return _combined(f, paragraph, -1)


def _filled(n: Column, ones: Column, exact: Column) -> Column:
    none = F.array(*[F.lit(0).cast("long")] * SIGNS)
    return F.struct(exact.alias("exact"), F.coalesce(n, F.lit(0)).alias("n"), F.coalesce(ones, none).alias("ones"))


def _keyed(documents: DataFrame) -> DataFrame:
    """Keys that are never null, so that joins on them keep the partitioning: the id (null
    as the least long, which the digest tells apart) and a hash of text and id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"),
                            F.xxhash64(text, F.col("doc_id")).alias("digest"), "doc_id", text.alias("text"))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, digest and ``f``, the fingerprint, of each different doc_id and text."""
    docs = _keyed(documents).dropDuplicates(_KEY)
    return docs.select(*_KEY, "doc_id", exact_lanes(F.col("text")).alias("exact")).join(summed(docs, _KEY), _KEY, "left") \
        .select("doc_id", "digest", _filled(F.col("n"), F.col("ones"), F.col("exact")).alias("f"))


def edited(documents: DataFrame) -> DataFrame:
    """Fingerprints of documents and of their edited texts, whose last third of code
    points gives way to the beginning of the next document by descending doc_id:
    doc_id, n_chars, edited_sha256, own, changed, next (fingerprints)."""
    docs = _keyed(documents)
    third = F.expr("char_length(text) div 3").cast("int")
    sizes = docs.select(*_KEY, third.alias("third")).distinct()
    order = stored(ranked_before(sizes, _KEY, [*_KEY, "third"], wrap=True).select(*_KEY, "before"), "order")

    # The only exchange of whole texts; every join and sum below keeps its partitioning.
    same = Window.partitionBy(*_KEY)
    one = docs.repartition(*_KEY).withColumn("nth", F.row_number().over(same.orderBy("doc_id"))) \
        .withColumn("copies", F.count("*").over(same)).where("nth = 1").drop("nth")
    heads = one.join(order, _KEY).join(summed(one, _KEY), _KEY, "left").select(
        F.col("before.id").alias("id"), F.col("before.digest").alias("digest"),
        F.substring(F.col("text"), F.lit(1), F.col("before.third")).alias("head"),
        _filled(F.col("n"), F.col("ones"), exact_lanes(F.col("text"))).alias("next"))
    whole = one.join(heads, _KEY)
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - third)
    changed = F.concat(kept, F.col("head"))
    facts = whole.select(*_KEY, "doc_id", "copies", F.char_length("text").cast("long").alias("n_chars"),
                         F.sha2(changed, 256).alias("edited_sha256"), "next",
                         exact_lanes(F.col("text")).alias("exact"), exact_lanes(changed).alias("changed_exact"))
    sides = whole.select(*_KEY, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text")), F.struct(F.lit(1).alias("side"), changed.alias("text")))).alias("_")) \
        .select(*_KEY, "_.*")
    pick = lambda side: F.first(F.when(F.col("side") == side, F.struct("n", "ones")), ignorenulls=True)
    sums = summed(sides, [*_KEY, "side"]).groupBy(*_KEY).agg(pick(0).alias("own"), pick(1).alias("changed"))
    return facts.join(sums, _KEY, "left").select(
        "doc_id", "n_chars", "edited_sha256",
        _filled(F.col("own.n"), F.col("own.ones"), F.col("exact")).alias("own"),
        _filled(F.col("changed.n"), F.col("changed.ones"), F.col("changed_exact")).alias("changed"), "next",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")
