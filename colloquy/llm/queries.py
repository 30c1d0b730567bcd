"""The registered query of each operator, over its whole table, and DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import oracles
from colloquy.llm.decontamination import contamination
from colloquy.llm.html_extraction import extracted
from colloquy.llm.html_extraction import learn as learn_layout
from colloquy.llm.language_id import identify, learn
from colloquy.llm.mixing import mix_sources
from colloquy.llm.near_dedup import near_duplicates
from colloquy.llm.pitman_yor import scored
from colloquy.llm.quality_rules import quality
from colloquy.llm.shared import table
from colloquy.llm.substring_dedup import dedup_substrings
from colloquy.llm.suffix_dedup import dedup_strings
from colloquy.llm.token_alignment import aligned
from colloquy.llm.url_filters import filtered, host_of
from colloquy.llm.warc import archived
from colloquy.llm.whitening import whitened

documents, pages, benchmark, labels, embeddings = (table(x) for x in ("documents", "pages", "benchmark", "labels", "embeddings"))
#: Folder of the tokenizers' files, and the two that are aligned.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "rate", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir).select("doc_id", "quality"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` with a day of fetch, derived from the id; the table has none."""
    return pages(spark, sf_dir).withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.coalesce("page_id", F.lit(0)) * 37, F.lit(365)).cast("int")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(captured(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "timestamp", "capture")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), benchmark(spark, sf_dir), window=13, percent=5, near=26)
    counts = [F.size(c).cast("long").alias(f"n_{c.removesuffix('_items')}") for c in ("items", "near_items")]
    return found.select("doc_id", "n_words", "n_hit", *counts, F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), words=3, percent=85)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_strings(documents(spark, sf_dir).select("doc_id", "text"), window=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def dated_list(captures: DataFrame) -> DataFrame:
    """A dated list over the hosts of `captures`: some are blocked, later let off or ended, by a hash of the domain."""
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    domains = hosts.select(F.explode(F.array("host", F.substring_index("host", ".", -3))).alias("domain")).distinct()
    drawn = domains.withColumn("h", F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("h") % 200).cast("int"))
    first = drawn.where("h % 3 < 2").select("domain", F.when(F.col("h") % 3 == 0, "block").otherwise("allow").alias("action"), day.alias("dated"))
    second = drawn.where("h % 3 = 0").select("domain", F.when(F.col("h") % 2 == 0, "end").otherwise("allow").alias("action"), F.date_add(day, 90).alias("dated"))
    return first.unionByName(second)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = captured(spark, sf_dir).select("page_id", "url", "fetched")
    return filtered(captures, dated_list(captures)).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "matched_domain", "action", F.col("valid_from").cast("string").alias("valid_from"), "blocked")


def held_out(modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id's text leaves `remainder`; a null id doesn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang").withColumn("held_out", held_out(3, 1))
    model = learn(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scored(docs, held_out(10, 0)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages(spark, sf_dir).select("page_id", "url", "html")
    return extracted(found, learn_layout(found))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(documents(spark, sf_dir).select("doc_id", "text"), f"{TOKENIZERS}/{BYTE_BPE}", f"{TOKENIZERS}/{PIECE_BPE}")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(embeddings(spark, sf_dir).select("vec_id", "embedding"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_decontamination": op4_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_minhash": op6_minhash,
    "op7_url_filters": op7_url_filters,
    "op8_suffix_array": op8_suffix_array,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_html_extraction": op11_html_extraction,
    "op12_token_alignment": op12_token_alignment,
    "op13_whitening": op13_whitening,
}

ORACLES = {
    "op1_mixing": oracles.MIXING,
    "op3_warc": oracles.WARC,
    "op4_decontamination": oracles.DECONTAMINATION,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op6_minhash": oracles.NEAR_DEDUP,
    "op7_url_filters": oracles.URL_FILTERS,
    "op11_html_extraction": oracles.HTML_EXTRACTION,
}
