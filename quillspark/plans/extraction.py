"""Whole extraction plans: documents to mentions, clusters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scoring import RuleScorer, Scorer
from quillspark.functions.text import find_citations, find_urls
from quillspark.operators import cascade, dedup, lexicon, match, report, segment
from quillspark.plans.storage import Workspace
from quillspark.sources.writers import report_json


def with_text_parts(sentences: DataFrame) -> DataFrame:
    """Adds citations and URLs; of sentences with candidates only, since their patterns are many."""
    return sentences.withColumns({"citations": find_citations("text"), "urls": find_urls("text")})


def with_own_entries(sentences: DataFrame, lexicon_rows: DataFrame, scorer: Scorer, base: DataFrame, data_phrases: DataFrame, software_phrases: DataFrame) -> DataFrame:
    """Lexicon rows of single documents: what fast answers to their sentences name and the base does not have."""
    single = sentences.select("doc_id", "sec", F.struct("par", "sent").alias("par"), "text").withColumn("sent", F.lit(0))
    hits = match.number_candidates(match.match_lexicon(single, lexicon_rows))
    texts = single.select("doc_id", "sec", "par", F.col("text").alias("paragraph"))
    answers = report.fast_rows(texts, hits).select("doc_id", F.col("results").alias("answer"))
    entries = lexicon.from_answers(answers)
    fresh = entries.join(lexicon.new_entries(entries.select("phrase", "type"), base, data_phrases, software_phrases), ["phrase", "type"], "left_semi")
    kind = F.when(F.col("type") == "Dataset", "gaz_dataset").otherwise("gaz_method")
    return fresh.select("doc_id", F.lit(2**30).alias("rank"), "phrase", kind.alias("kind"))


def candidates(sentences: DataFrame, lexicon_rows: DataFrame, own_rows: DataFrame | None = None) -> DataFrame:
    """Numbered and annotated candidates of (doc_id, sec, title, par, sent, text)."""
    ready = sentences if "snippet_start" in sentences.columns else segment.with_offsets(sentences)
    found = match.match_lexicon(ready, lexicon_rows)
    if own_rows is not None:
        found = found.unionByName(match.match_lexicon(ready, own_rows))
    return match.annotated(match.number_candidates(with_text_parts(found)))


def extract(sentences: DataFrame, lexicon_rows: DataFrame, scorer: Scorer | None = None, filter_paragraphs: bool = False, deduplicate: bool = True, own_rows: DataFrame | None = None, thresholds: dict | None = None) -> dict[str, DataFrame]:
    """``mentions`` (all candidates with their answers) and ``clusters`` (the valid ones with label and cluster)."""
    scorer = scorer or RuleScorer()
    found = candidates(sentences, lexicon_rows, own_rows)
    if filter_paragraphs:
        texts = segment.paragraph_texts(sentences)
        answers = report.fast_rows(texts, found).where("candidates != ''").select("doc_id", "sec", "par", F.col("results").alias("answer"))
        found = cascade.relevant_paragraphs(found, answers)
    # dedup and every report read the mentions: they are written once
    mentions = Workspace(sentences.sparkSession, "extract").save(cascade.run_cascade(found, scorer, thresholds))
    clusters = dedup.deduplicate(mentions) if deduplicate else dedup.without_dedup(mentions)
    return {"mentions": mentions, "clusters": clusters}


def extract_fast(sentences: DataFrame, lexicon_rows: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Paragraphs with their candidates and the answer to the list question."""
    found = match.number_candidates(match.match_lexicon(sentences, lexicon_rows))
    return report.fast_rows(segment.paragraph_texts(sentences), found, answers)


def reevaluate(mentions: DataFrame, artifact: float = 0.8, ownership: float = 0.8, reuse: float = 0.8, by_section: bool = True, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reports of earlier mentions under new thresholds: mentions below go, the rest clusters again.

    With the parsed documents also their tables (``report.document_tables``) and ``report``: all five as one JSON text
    for each document.
    """
    kept = cascade.apply_thresholds(mentions.where("valid AND NOT skipped"), artifact, ownership, reuse)
    clusters = dedup.deduplicate(kept)
    out = {"clusters": clusters, "artifacts": report.artifacts(clusters, by_section), "mentions": report.mention_rows(clusters)}
    if documents is not None:
        out |= report.document_tables(documents)
        # both tables are read twice, by their own sinks and by the report
        work = Workspace(mentions.sparkSession, "reports")
        out |= {name: work.save(out[name]) for name in ("artifacts", "mentions")}
        by_target = out["citances"].select("doc_id", "key", *(c for c in out["citances"].columns if c not in ("doc_id", "key")))
        out["report"] = report_json(out["publication_info"], out["artifacts"], out["mentions"], out["citations"], by_target)
    return out
