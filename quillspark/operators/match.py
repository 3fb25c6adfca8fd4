"""Matching a lexicon in sentences: an equi-join by one word of each phrase in place of a loop over both.

A phrase matches from word boundary to word boundary, so each of its words is a whole word of the sentence, and a phrase
of signs only is all that stands between two words. Phrases are looked up by one word each: the one that fewest phrases
share, then the longest. Only (sentence, phrase) pairs that pass, and whose sentence contains the phrase, get the exact
regular expression, which gives spans as a left-to-right scan without overlaps does. The lexicon is measured first: up
to ``BROADCAST_BYTES`` it is broadcast, and sentences don't move; beyond that both sides shuffle by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.fixed import KINDS, TYPE_OF_KIND
from quillspark.functions.text import annotate, quoted, starts_of
from quillspark.operators.segment import SENTENCE_KEYS

WORDS, PIECES = r"(?U)(\w+)", r"(?U)(\w+|\W+)"
#: Largest text of a lexicon, in bytes, that is sent to every executor.
BROADCAST_BYTES = 32 << 20
#: Most rows of a lexicon whose phrases lines are searched for before they are split.
FEW_ROWS = 64


def contains(text: Column, phrase: Column) -> Column:
    """Plain substring, whatever the case."""
    return F.lower(text).contains(F.lower(phrase))


def prepare(lexicon: DataFrame) -> DataFrame:
    """Adds ``low, size, key`` to lexicon rows; the key of a phrase without a word is the phrase."""
    low = F.lower("phrase")
    rows = lexicon.where("phrase IS NOT NULL AND phrase != ''").withColumns({"low": low, "size": F.length(low)})
    words = rows.select("low").distinct().select("low", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(WORDS), F.lit(1)))).alias("word"))
    shared = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", -F.length("word"), "word")
    keys = words.join(shared, "word").groupBy("low").agg(F.min_by("word", rank).alias("key"))
    return rows.join(keys, "low", "left").withColumn("key", F.coalesce("key", "low"))


def may_match(lexicon: DataFrame) -> Callable[[Column], Column] | None:
    """A plain test of texts, true for every text with a sentence that matches; none for a lexicon of many rows.

    A sentence has the signs of its text in their order, but for white space, so it holds a phrase only if the text
    holds each part of the phrase between spaces.
    """
    rows = lexicon.where("phrase IS NOT NULL AND phrase != ''").select(F.lower("phrase")).limit(FEW_ROWS + 1).collect()
    if len(rows) > FEW_ROWS:
        return None
    phrases = sorted({tuple(dict.fromkeys(part for part in r[0].split(" ") if part)) for r in rows})

    def holds(low: Column) -> Column:
        found = F.lit(False)
        for parts in phrases:
            held = F.lit(True)
            for part in parts:
                held = held & low.contains(part)
            found = found | held
        return found

    return lambda text: F.exists(F.array(F.lower(text)), holds)  # an array of one, so that the text is lower-cased once


def match_lexicon(sentences: DataFrame, lexicon: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row for each span and lexicon row: the sentence's columns, ``kind, phrase, rank, start, end``.

    Spans are half-open code points of the lower-cased sentence. Case variants of a phrase give rows of their own. A
    lexicon with ``doc_id`` applies to that document only. Null sentences match nothing.
    """
    on = ["key", "doc_id"] if "doc_id" in lexicon.columns else ["key"]
    rows = prepare(lexicon).select(*on, "rank", "phrase", "kind", "low", "size")
    held, signs_only = rows.agg(F.sum(F.octet_length("phrase") + F.octet_length("low") + F.octet_length("key") + 64), F.max((F.col("key") == F.col("low")) & ~F.col("low").rlike(r"(?U)\w"))).head()
    pieces = F.regexp_extract_all(F.lower("text"), F.lit(PIECES if signs_only else WORDS), F.lit(1))
    exploded = sentences.where("text IS NOT NULL").withColumn("key", F.explode(F.array_distinct(pieces)))
    found = exploded.join(F.broadcast(rows) if (held or 0) <= BROADCAST_BYTES else rows, on).drop("key")
    found = found.where(F.lower("text").contains(F.col("low")))
    pattern = F.concat(F.lit(r"(?U)\b"), quoted("low"), F.lit(r"\b"))
    spans = found.withColumn("start", F.explode(starts_of(F.lower("text"), pattern, "size")))
    return spans.withColumn("end", F.col("start") + F.col("size")).drop("low", "size")


def kind_type(kind: Column) -> Column:
    """The type of a kind; unknown kinds stand for themselves."""
    known = F.create_map(*(F.lit(x) for pair in TYPE_OF_KIND.items() for x in pair))
    return F.coalesce(F.try_element_at(known, kind), kind)


def number_candidates(matches: DataFrame) -> DataFrame:
    """Adds ``cand_no`` and ``mention_id``: places in a document's order of span, kind and lexicon rank."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    window = Window.partitionBy("doc_id").orderBy("sec", "par", "sent", "start", "end", order, "rank", "phrase")
    numbered = matches.withColumn("cand_no", (F.row_number().over(window) - 1).cast("int"))
    return numbered.withColumn("mention_id", F.concat(F.lit("C"), F.col("cand_no"))).withColumn("type", kind_type(F.col("kind")))


def annotated(candidates: DataFrame) -> DataFrame:
    """Adds ``annotated``: the sentence with the trigger between <m> and </m>."""
    return candidates.withColumn("annotated", annotate("text", "start", "end"))


def by_paragraph(candidates: DataFrame) -> DataFrame:
    """Annotated sentences of each paragraph and type, in candidate order."""
    ordered = F.array_sort(F.collect_list(F.struct("cand_no", "annotated")))
    return candidates.groupBy("doc_id", "sec", "par", "type").agg(F.transform(ordered, lambda x: x["annotated"]).alias("annotated"))
