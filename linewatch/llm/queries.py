"""The operators as queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewatch.llm import (binary_codes, licences, mixing, multiset, packing, periodic, repeats, simhash, token_store, topk, toxicity,
                           whitening, wrapper)
from linewatch.llm.common import scratch, table
from linewatch.llm.sql import MIXING, TOPK
from linewatch.queries import Entry


@functools.cache
def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file is on this machine; it is installed on all executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(documents, labels.where(toxicity.learnable(F.col("doc_id"))))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return toxicity.scored(documents, model, ["doc_id"]).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = multiset.edited(table(spark, sf_dir, "documents"))
    own, changed, following = F.col("own"), F.col("changed"), F.col("next")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", multiset.text_form(own).alias("fingerprint"),
        multiset.text_form(changed).alias("edited_fingerprint"), multiset.likeness(own, changed).alias("near_edited"),
        multiset.likeness(own, following).alias("near_next"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.deduplicated(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "text", "removed", gone.alias("removed_chars"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-ids")
    token_store.write(table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return token_store.digests(spark, path)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer(), end_id=1).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source and language; every 25th is the licence file of its directory."""
    number = F.coalesce(F.col("doc_id"), F.lit(0))
    deep = F.pmod(F.expr("coalesce(doc_id, 0) div 25"), F.lit(40))
    folder = F.concat_ws("/", "source", F.when(deep % 20 != 0, F.col("lang")), F.when(deep % 4 != 0, F.concat(F.lit("d"), deep)))
    name = F.when(number % 25 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("f"), number, F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.concat_ws("/", folder, name).alias("path"), "text")
    return licences.scanned(files).withColumnRenamed("key", "doc_id").select(
        "doc_id", "path", "own_licence", "own_score", "own_line", "licence", "inherited_from")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), most=8)


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_codes.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = periodic.found(with_periodic_tails(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"),
                                                                 (-r["period"]).alias("finer"))))
    return runs.withColumn("_longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_longest.before")).alias("start"),
        F.col("_longest.length").alias("length"), (-F.col("_longest.finer")).alias("period"),
        F.expr("1000 * _longest.length div -_longest.finer").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, where every tenth text (by a hash of the id; a null id has none) repeats
    itself from some word on, as the contract of op13 says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), F.size("_words").cast("long")
    edited = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, F.expr(
        r"regexp_extract_all(text, '([^\\x20\\x09-\\x0D]+)', 1)")).alias("_words"))
    edited = edited.withColumn("_a", F.when(n > 0, g % n))
    edited = edited.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    tiled = F.expr("array_join(transform(_words, (w, i) -> if(i < _a, w, _words[int(_a + (i - _a) % _p)])), ' ')")
    return edited.select("doc_id", F.when(F.col("_a").isNotNull(), tiled).otherwise(F.col("text")).alias("text"))


def load() -> dict[str, Entry]:
    sql = {"op7_mixing": MIXING, "op9_top_k": TOPK}
    found = (op1_toxicity, op2_fingerprint, op3_repeats, op4_simhash, op5_token_files, op6_packing, op7_mixing,
             op8_main_text, op9_top_k, op10_licences, op11_whitening, op12_nearest, op13_periodic_runs)
    return {f.__name__: Entry(f, sql.get(f.__name__)) for f in found}
