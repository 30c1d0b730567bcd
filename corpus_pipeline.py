"""Corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

Every stage takes any rows with the columns of `documents`, nulls in all of them included, and an
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm.decontamination import contamination
from colloquy.llm.language_id import UNKNOWN, identify, learn
from colloquy.llm.mixing import emitted, mix_sources
from colloquy.llm.near_dedup import near_duplicates
from colloquy.llm.shared import table, work_dir
from colloquy.llm.substring_dedup import dedup_substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language that their text is told to be in as their `lang`, whatever it was.

    The languages are learned from the labelled documents whose id's CRC-32 isn't 1 modulo 3. Null
    texts and texts without a letter have no language and go; if nothing is labelled, all do.
    """
    known = docs.select(*COLUMNS)
    labelled = known.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True)))
    told = identify(known, learn(labelled)).where(F.col("lang_pred") != UNKNOWN)
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id; of rows that share its id, all.

    A null id is the least of all. Texts without words are in no group and stay.
    """
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 20-word windows that also start earlier; texts that lose none stay as they are.

    A document of which nothing is left goes. Rows alike in id and text are one document here.
    """
    found = dedup_substrings(docs.select(*COLUMNS), window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    changed = found.withColumn("text", text).where((F.col("n_removed") == 0) | (F.length("text") > 0))
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in benchmark windows; null texts have no words and stay."""
    found = contamination(docs.select(*COLUMNS), table("benchmark")(spark, sf_dir), window=13, percent=5)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, numbered by copy; a null source is one of its own, the last."""
    mixed = mix_sources(docs.select(*COLUMNS), weights=(3, 1, 2), share=1.5, most=2.0)
    return emitted(mixed).select(*COLUMNS, "copy")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Language ID and the substring stage's rewritten texts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of `sf_dir`."""
    docs = table("documents")(spark, sf_dir)
    for name, stage in STAGES:
        path = work_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
