"""The queries of the llm operators, one for each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm._rows import table
from quillspark.llm.chat_format import Template, format_conversations, read_back
from quillspark.llm.embedding_dedup import near_dedup
from quillspark.llm.line_spread import remove_boilerplate
from quillspark.llm.mixing import mix_sources
from quillspark.llm.ngram_jaccard import jaccard_components
from quillspark.llm.quality_rules import quality_rules
from quillspark.llm.sql import EXTRA_CONVERSATION, FIRST_DAY, URL_ENTRIES, VOCABULARY, WEIGHTS, oracles
from quillspark.llm.substring_dedup import substring_dedup
from quillspark.llm.toxicity import learn, score_documents
from quillspark.llm.url_lists import filter_urls


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame(EXTRA_CONVERSATION, "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(*columns).unionByName(more)
    template = Template()
    return read_back(format_conversations(turns, template), template)


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages hold no day of capture; it is derived from the id."""
    pages = table(spark, sf_dir, "pages")
    after = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    captures = pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), after).alias("day"))
    entries = spark.createDataFrame(URL_ENTRIES, "list string, key string, verdict string, action string, day string")
    found = filter_urls(captures, entries.withColumn("day", F.col("day").cast("date")))
    return found.withColumn("day", F.col("day").cast("string"))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = remove_boilerplate(docs)
    lines = F.size(F.split(F.col("text"), "\n", -1)).cast("long")
    return kept.select(
        "doc_id", F.col("removed_").cast("long").alias("n_removed"), F.when(F.col("text") == "", 0).otherwise(lines).alias("n_lines_left"),
        F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, pattern)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), WEIGHTS)
    return placed.select("doc_id", "source", F.col("block_").cast("long").alias("block"), F.col("slot_").cast("long").alias("slot"), F.col("start_").cast("long").alias("start"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that is left of each document, and the runs that went: start, end, words and keeper's id."""
    kept = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed_", lambda x: F.concat_ws(":", x["start"], x["end"], x["words"], x["keeper"])), ",")
    words = F.aggregate("removed_", F.lit(0).cast("long"), lambda n, x: n + x["words"])
    return kept.select("doc_id", "text", F.size("removed_").cast("long").alias("n_removed"), words.alias("n_words_removed"), spans.alias("removed_spans"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_url_lists": op2_url_lists,
    "op3_line_spread": op3_line_spread,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity": op5_toxicity,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_substring_dedup": op10_substring_dedup,
}

ORACLES = oracles()
