"""A training corpus from raw documents: stages that each read what the one before wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last one
return the columns of ``documents``. Rows a stage drops are gone for the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.llm import mixing, packing, repeats, simhash, similar, toxicity
from linewatch.llm.common import stored, table
from linewatch.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _row() -> Column:
    """Tells rows apart: a hash of all their columns."""
    return F.xxhash64(*COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    labels = table(spark, sf_dir, "labels").where(toxicity.learnable(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs, model, COLUMNS).where("score < 0.5").select(COLUMNS)


def _firsts(found: DataFrame, label: str) -> DataFrame:
    """``row`` of the smallest id of each component (no id comes last, ties by content), how many rows it has and how many different ones."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    return stored(found.groupBy("component").agg(first.alias("first"), F.count_distinct("row").alias("rows"), F.count("*").alias("n"))
                  .select(F.col("first.row").alias("row"), "rows", "n"), label)


def _chosen(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``_firsts`` names. Only where whole rows repeat, one of them is picked by one more exchange."""
    chosen = docs.join(kept.select(F.col("row").alias("_row")), _row() == F.col("_row"), "left_semi").select(COLUMNS)
    return chosen.dropDuplicates(COLUMNS) if not kept.where("n > rows").isEmpty() else chosen


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. First the groups of ``op4_simhash``: SimHash fingerprints
    of three-word shingles, linked at two or fewer differing bits. Of the documents left, those whose sets of five-word
    shingles are similar at 0.8 or more, which two bits of 64 do not tell, are found by an exact check. Texts are exchanged
    once, when the result is picked."""
    named = docs.withColumn("row", _row())
    left = _firsts(simhash.near_duplicates(named, width=3, keep=("row",)), "fingerprint-kept").select("row")
    found = similar.similar(named, width=5, keep=("doc_id", "row"), among=left)
    return _chosen(docs, _firsts(found, "kept"))


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines and passages that an earlier document has."""
    return repeats.deduplicated(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    copies = F.explode(F.expr("array_repeat(0, copies)"))
    return mixing.mixed(docs).where("copies > 0").select(*COLUMNS, copies.alias("_")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer(), end_id=1)


STAGES = [("toxicity", clean), ("near_duplicates", one_of_a_kind), ("repeats", no_repeats), ("mix", mix), ("pack", pack)]

#: A trained classifier and a tokenizer are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
