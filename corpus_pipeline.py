"""Documents to token ids: five stages, each on all rows its predecessor kept.

A stage takes any further columns besides those of ``documents``, whatever their names; all but the last return them
as they are. Null texts and ids are rows like others, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe
from quillspark.llm._rows import col, free, table
from quillspark.llm.line_spread import remove_boilerplate, removed_name
from quillspark.llm.mixing import in_mixed_order, mix_sources, place_names
from quillspark.llm.ngram_jaccard import jaccard_components
from quillspark.llm.sql import VOCABULARY, WEIGHTS
from quillspark.llm.toxicity import learn, without_toxic
from quillspark.plans.storage import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon predicts to be toxic go."""
    return without_toxic(docs, learn(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but for their first occurrence; a document that loses its last line goes too."""
    kept = remove_boilerplate(docs)
    return kept.where((F.col(removed_name(docs.columns)) == 0) | (F.trim("text") != "")).select(*map(col, docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8, the smallest id stays."""
    linked = jaccard_components(docs, width=5, percent=80)
    # rows with a null id are in no group
    other = free("other_id_", docs.columns)
    others = linked.where("doc_id != component_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(others, F.col("doc_id") == F.col(other), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return in_mixed_order(docs, WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of every text, the digest of the bytes that they decode to, and the text's place in the mix.

    Files are not read in the order in which they were written, so the places are computed again: they depend on the
    rows only. The rows are sorted by them. A text is encoded and its ids decoded in one worker, with one encoder.
    """
    ranks, pattern = bpe.read_ranks(spark, public_tokenizers.path(VOCABULARY)), public_tokenizers.PATTERN
    docs = docs.select("doc_id", "text", "source")
    _, _, slot, start = place_names(docs.columns)
    placed = mix_sources(docs, WEIGHTS).orderBy(slot, start)  # encoding keeps the order, and moves no ids
    encoded = bpe.round_trip(placed, ranks, pattern, keep=(slot, start), with_ids=True)
    return encoded.select("doc_id", "n_tokens", "ids", "decoded_sha256", F.col(slot).alias("slot"), F.col(start).alias("start"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the learned lexicon nor the token ids; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written as Parquet in the shared folder and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, work.save(stage(spark, docs, sf_dir))
        if k:
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
