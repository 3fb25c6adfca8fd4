"""Streaming forms of the stateless transforms. The reference has no streams: this goes beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import match, segment


def match_stream(spark: SparkSession, path: str, lexicon_rows: DataFrame, schema: str = "doc_id long, text string", max_files: int = 100) -> DataFrame:
    """Matches of the Parquet files that arrive in a folder. Numbering needs a whole document and is left to a batch."""
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return match.match_lexicon(segment.sentences_of_texts(docs), lexicon_rows)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and type with a watermark; works on batches too."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
