"""Documents to sections, paragraphs and sentences, with their places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import split_sentences

SENTENCE_KEYS = ["doc_id", "sec", "par", "sent"]


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, par, text``: the lines of plain texts, numbered from 0. Null texts have none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("par", "text"))


def sentences_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, sec, title, par, sent, text``: one untitled section whose paragraphs are the lines.

    With ``offsets`` also ``snippet_start, snippet_end`` as ``with_offsets`` has them, without its shuffle. With
    ``where`` only lines that pass are split; it must hold for a text with such a line too.
    """
    lines = paragraphs(docs if where is None else docs.where(where(F.col(text_col))), id_col, text_col)
    if where is not None:
        lines = lines.where(where(F.col("text")))
    keys = ["doc_id", F.lit(0).alias("sec"), F.lit(None).cast("string").alias("title"), "par"]
    if not offsets:
        return lines.select(*keys, F.posexplode(split_sentences("text")).alias("sent", "text"))
    split = lines.select(*keys, split_sentences("text").alias("parts_"))
    none = F.array().cast("array<int>")
    starts = F.aggregate("parts_", F.struct(none.alias("all"), F.lit(0).alias("at")), lambda s, x: F.struct(F.concat(s["all"], F.array(s["at"])).alias("all"), (s["at"] + F.length(x) + 1).alias("at")), lambda s: s["all"])
    zipped = split.select("doc_id", "sec", "title", "par", F.posexplode(F.arrays_zip("parts_", starts.alias("starts_"))).alias("sent", "x_"))
    zipped = zipped.select("doc_id", "sec", "title", "par", "sent", F.col("x_.parts_").alias("text"), F.col("x_.starts_").alias("snippet_start"))
    return zipped.withColumn("snippet_end", F.col("snippet_start") + F.length("text"))


def sentences_of_lists(docs: DataFrame, id_col: str = "doc_id", list_col: str = "text_list", split: bool = False) -> DataFrame:
    """The same of paragraphs given as lists of sentences; with split these are split further, in their paragraph."""
    par = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(list_col).alias("par", "s"))
    inner = F.flatten(F.transform("s", split_sentences)) if split else F.col("s")
    return par.select("doc_id", F.lit(0).alias("sec"), F.lit(None).cast("string").alias("title"), "par", F.posexplode(inner).alias("sent", "text"))


def sentences_of_sections(docs: DataFrame, id_col: str = "doc_id", sections_col: str = "sections") -> DataFrame:
    """The same of ``array<struct<title, paragraphs: array<array<string>>>>``."""
    sec = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(sections_col).alias("sec", "s"))
    par = sec.select("doc_id", "sec", F.col("s.title").alias("title"), F.posexplode("s.paragraphs").alias("par", "p"))
    return par.select("doc_id", "sec", "title", "par", F.posexplode("p").alias("sent", "text"))


def abstract_first(sections: str = "sections"):
    """A last section titled Abstract moves to the front."""
    s = F.col(sections)
    last = F.try_element_at(s, F.lit(-1))
    return F.when(last["title"] == "Abstract", F.concat(F.slice(s, -1, 1), F.slice(s, F.lit(1), F.size(s) - 1))).otherwise(s)


def with_offsets(sentences: DataFrame) -> DataFrame:
    """Adds ``snippet_start, snippet_end``: the sentence's span in its paragraph joined by single spaces."""
    before = Window.partitionBy("doc_id", "sec", "par").orderBy("sent").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("int")
    return sentences.withColumn("snippet_start", start).withColumn("snippet_end", F.col("snippet_start") + F.length("text"))


def paragraph_texts(sentences: DataFrame) -> DataFrame:
    """``doc_id, sec, par, title, paragraph, paragraph_start, paragraph_end``: spans in the section's joined text."""
    ordered = F.array_sort(F.collect_list(F.struct("sent", "text")))
    joined = sentences.groupBy("doc_id", "sec", "par").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("paragraph"), F.max("title").alias("title"))
    before = Window.partitionBy("doc_id", "sec").orderBy("par").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("paragraph") + 1).over(before), F.lit(0)).cast("int")
    return joined.withColumn("paragraph_start", start).withColumn("paragraph_end", F.col("paragraph_start") + F.length("paragraph"))


def section_texts(sentences: DataFrame) -> DataFrame:
    """``doc_id, sec, section``: all sentences of a section joined by single spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("par", "sent", "text")))
    return sentences.groupBy("doc_id", "sec").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("section"))
