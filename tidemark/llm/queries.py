"""One query for each operator, over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    embedding, importance, kdtree, langid, mixing, multiset, packing, passages, periods, simhash, tokenbin, toxicity, warc,
)
from tidemark.llm.common import table

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"

# The mixture of the query: shares of domains, languages and sources; names not listed weigh 1.
DOMAINS = ("web", "books", "forums", "reference")
WEIGHTS = (
    {"web": 0.4, "books": 0.3, "forums": 0.1, "reference": 0.2},
    {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    {},
)
MIX_SHARE = 0.8
MIX_EPOCHS = 2
MIX_SEED = 17


def domain_of(source: str = "source"):
    """Domain of a source by the number in its name; sources without a number are web."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*(F.lit(d) for d in DOMAINS)), F.pmod(number, F.lit(len(DOMAINS))).cast("int") + 1)


def op1_token_binary(spark: SparkSession, folder: str) -> DataFrame:
    found = tokenbin.round_trip(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER))
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = mixing.mixed_prefixes(docs, MIX_SHARE, WEIGHTS, domain_of(), MIX_EPOCHS, MIX_SEED)
    return found.select(
        F.col("key").alias("doc_id"), "domain", "lang", "source", "epoch", F.col("tokens").alias("n_tokens"),
        F.col("take").cast("long").alias("take_tokens"), F.col("chars").alias("prefix_chars"), F.col("crc32").alias("prefix_crc32"),
    )


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    found = packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return found.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op6_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return multiset.compare_edited(table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select(
        "doc_id", "held_out", "score", "predicted", F.size("sentences").cast("long").alias("n_toxic_sentences")
    )


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.round_trip(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_join(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.embedding_classes(table(spark, folder, "embeddings"))


def op10_passages(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "start", "end", "n_words", "other_doc_id", "other_start_word", "other_n_words", "equal_words",
        "similarity", F.col("later"),
    )


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = kdtree.kd_shards(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _periodic(doc_id: str = "doc_id", text: str = "text"):
    """The text; for one document in ten, by the CRC of its key, with words from some place on that repeat a period."""
    h = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(1))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    a, p = (c.cast("int") for c in (a, p))
    periods_of = F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))
    again = F.concat(F.slice(words, F.lit(1), a), F.slice(F.flatten(periods_of), F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(again, " ")).otherwise(F.col(text))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", _periodic().alias("text"))
    found = periods.periodic_runs(docs).withColumn("best", periods.longest_run())
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_binary, op2_simhash, op3_language_id, op4_mixing, op5_packing, op6_multiset_hash,
        op7_toxicity, op8_warc, op9_embedding_join, op10_passages, op11_importance, op12_kd_shards,
        op13_periodic_runs,
    )
}

ORACLE_SQL: dict[str, str] = {}
