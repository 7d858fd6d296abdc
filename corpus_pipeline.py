"""A corpus pipeline of five stages: each takes what the one before kept, as the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import langid_crf
from lattica.llm.common import stored, table, without
from lattica.llm.decontaminate import decontaminate
from lattica.llm.queries import fold
from lattica.llm.sentencepiece_scan import sentencepiece_encode
from lattica.llm.simhash_dedup import simhash_components
from lattica.llm.substring_dedup import substring_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language is undetermined or the best language's share of its words is below this.
LEAST_LANGUAGE_SCORE = 0.4
#: The SQL can't express the trained and hashed stages; tests hold run() against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, with lang set to it where it was null."""
    crf = langid_crf.train(docs.where(~fold("doc_id", 4, 2)), key_cols=["doc_id"])
    found = docs.select(*COLUMNS, langid_crf.language(crf, F.col("text")).alias("found"))
    kept = found.where((F.col("found.lang") != "und") & (F.col("found.score") >= LEAST_LANGUAGE_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "found.lang").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group; rows that share an id are one document. Only ids leave the documents, no texts."""
    found = simhash_components(docs).groupBy("doc_id").agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    return without(docs.select(*COLUMNS), found.where("not kept").select("doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier one has; those with nothing left go. Texts that lose nothing stay as they are."""
    done = substring_dedup(docs.select(*COLUMNS), carry=("lang", "source", "n_chars"), with_text=True)
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept"))
    kept = done.where("n_words > n_removed").select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))
    return kept.select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without(docs.select(*COLUMNS), decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each document that is left."""
    coded = sentencepiece_encode(docs, carry=("lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("pieces").cast("long").alias("n_pieces"), "pieces")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("without_benchmark", without_benchmark), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's result is written and read again, so that a lost executor costs one stage at most."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
