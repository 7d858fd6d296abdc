"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, langid_crf, toxicity_mil, url_filter
from .common import table
from .decontaminate import decontaminate
from .quality_rules import quality_rules
from .sentencepiece_scan import sentencepiece_encode
from .simhash_dedup import simhash_components
from .substring_dedup import ORACLE as SUBSTRING_ORACLE
from .substring_dedup import substring_dedup
from .token_counts import token_counts


def fold(id_col: str, parts: int, held: int):
    """Whether an id is of the fold that is held out: crc32 of the id as text, modulo parts."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)) == held, F.lit(False))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), lang_col="lang")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    extra = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat_format.digests(chat_format.windows(turns.unionByName(extra)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # A stand-in for a list that is fed from outside, stated by a rule.
    return url_filter.url_filter(pages, url_filter.listed_urls(url_filter.stated_list(spark)))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 4, 2))
    crf = langid_crf.train(docs.where("not held_out"), key_cols=["doc_id"])
    found = docs.select("doc_id", "held_out", langid_crf.language(crf, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5, 0))
    labels = table(spark, sf_dir, "labels")
    mil = toxicity_mil.train(docs.where("not held_out"), labels.where(~fold("doc_id", 5, 0)))
    scored = docs.select("doc_id", "held_out", toxicity_mil.toxicity(mil, F.col("text")).alias("found"))
    return scored.select("doc_id", "held_out", "found.score", (F.col("found.score") >= 0.5).cast("int").alias("predicted"), F.col("found.sentences").alias("offending"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    seen = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")), 256)
    docs = docs.select("doc_id", "text", seen.alias("seen_sha256"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))
    coded = sentencepiece_encode(docs, carry=("seen_sha256", "n_chars"), decode=True)
    out = coded.select("doc_id", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"), "n_chunks", "n_states", "seen_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
    return out.select("doc_id", "n_chars", "n_pieces", "pieces_hash", "n_chunks", "n_states", "decoded_sha256", (F.col("seen_sha256") == F.col("decoded_sha256")).alias("round_trip"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash_dedup, op3_token_counts, op4_chat_format, op5_url_filter, op6_language_id, op7_substring_dedup, op8_toxicity, op9_sentencepiece, op10_decontaminate)}
ORACLES = {"op4_chat_format": chat_format.ORACLE, "op5_url_filter": url_filter.ORACLE, "op7_substring_dedup": SUBSTRING_ORACLE}
