"""Mixing sources to target weights by capped water-filling.

``targets`` shares a budget out by weight, clamps sources at ``max_epochs`` times
their size and shares what is over among the others, again and again until none is
above. ``mixed`` then takes every document the whole number of times that its
source's rate allows, and fills the fraction with documents in the order of a seeded
hash until the source's target is met to within half a document.

The place where a source's order is cut is found without sorting a source: sizes
are summed by 1024 ranges of the hash, then by 1024 ranges of the range that holds
the cut, and only the documents of one range in a million are put in order.

Nulls and odd rows: a null text has size 0 and is taken like any other of that size (0
words); null sources are one source, ranked last; the hash is of doc_id and text, so
rows that repeat are interchangeable; an empty table gives an empty result; other columns are passed on
where the caller asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewatch.llm.common import stored

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
_RANGE = 10  # bits a level


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def chance(doc_id: Column, text: Column) -> Column:
    """Seeded hash below 2^32, the same wherever and whenever it is worked out."""
    name = F.concat_ws(":", F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def weighted(sizes: DataFrame) -> DataFrame:
    """``sizes``: one row a source (source, source_size); adds its weight by rank."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    return sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int")))


def targets(sources: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to one row a source (source, source_size, weight). Two numbers a
    round come to the driver; each round but the last clamps at least one source."""
    cap = F.col("source_size") * F.lit(max_epochs)
    budget = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, clamped = None, -1
    while True:
        above = F.lit(False) if level is None else cap < F.lit(level) * F.col("weight")
        full, free, n = sources.agg(
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
            F.count(F.when(above, 1))).first()
        if n == clamped or not free:
            break
        level, clamped = (budget - full) / free, n
    return sources.withColumn("target", F.least(cap.cast("double"), F.lit(level or 0.0) * F.col("weight")))


def mixed(documents: DataFrame, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add size, source_size, target and ``copies``, how often the mix takes a document."""
    own = ["size", "source_size", "target", "copies"]
    documents = documents.drop(*own).withColumn("size", words(F.col("text"))).withColumn(
        "_chance", chance(F.col("doc_id"), F.col("text")))
    docs = stored(documents.select("source", "size", "_chance"), "sizes")
    coarse = F.expr(f"shiftright(_chance, {32 - _RANGE})")
    fine = F.expr(f"shiftright(_chance, {32 - 2 * _RANGE})")
    buckets = stored(docs.groupBy("source", coarse.alias("at")).agg(F.sum("size").alias("size")), "ranges")
    sources = stored(weighted(buckets.groupBy("source").agg(F.sum("size").alias("source_size"))), "sources")
    aims = stored(targets(sources, share, max_epochs).withColumn("whole", F.when(F.col("source_size") == 0, 0).otherwise(
        F.floor(F.col("target") / F.col("source_size")))).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")), "aims")

    def cut(sums: DataFrame, need: DataFrame) -> DataFrame:
        """The range in which the sum reaches what is needed, and what is needed inside."""
        so_far = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("at").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        held = sums.withColumn("below", so_far).join(need, sums["source"].eqNullSafe(need["_source"]))
        return (held.where("below < rest and below + size >= rest")
                .select("_source", F.col("at").alias("_at"), (F.col("rest") - F.col("below")).alias("rest")))

    need = aims.select(F.col("source").alias("_source"), "rest")
    outer = stored(cut(buckets, need), "cut")
    inside = docs.join(outer, docs["source"].eqNullSafe(outer["_source"]) & (coarse == F.col("_at")))
    finer = inside.groupBy("source", fine.alias("at")).agg(F.sum("size").alias("size"))
    inner = stored(cut(finer, outer.select("_source", "rest")), "cut")
    last = docs.join(inner, docs["source"].eqNullSafe(inner["_source"]) & (fine == F.col("_at")))
    order = Window.partitionBy("source").orderBy("_chance", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = (last.withColumn("below", F.coalesce(F.sum("size").over(order), F.lit(0)))
            .where("below + size / 2 <= rest").groupBy("source").agg(F.max(F.struct("_chance", "size")).alias("edge")))
    known = aims.join(edge.select(F.col("source").alias("_s"), "edge"), aims["source"].eqNullSafe(F.col("_s")), "left") \
        .join(inner.select(F.col("_source").alias("_i"), F.col("_at").alias("cut")), aims["source"].eqNullSafe(F.col("_i")), "left") \
        .select(F.col("source").alias("_aim"), "source_size", "target", "whole", "rest", "edge", "cut")
    joined = documents.join(stored(known, "known"), documents["source"].eqNullSafe(F.col("_aim")))
    extra = F.when(F.col("rest") <= 0, 0).when(F.col("cut").isNull(), 1).when(fine < F.col("cut"), 1).when(
        F.col("edge").isNotNull() & (F.struct("_chance", "size") <= F.col("edge")), 1).otherwise(0)
    return joined.withColumn("copies", (F.col("whole") + extra).cast("int")).drop(
        "_chance", "_aim", "whole", "rest", "edge", "cut")
