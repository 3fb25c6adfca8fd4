"""Command line: extract from files, re-evaluate, write reports."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.fixed import DATA_PHRASES, SOFTWARE_PHRASES
from quillspark.functions.scoring import RuleScorer
from quillspark.operators import lexicon, report, segment
from quillspark.plans.extraction import extract, extract_fast, reevaluate, with_own_entries
from quillspark.plans.storage import exists
from quillspark.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    p.add_argument("--input_dir", required=True)
    p.add_argument("--output_dir", required=True)
    mode = p.add_mutually_exclusive_group()
    for name in ("text_mode", "xml_mode", "parquet_mode", "pdf_mode"):
        mode.add_argument(f"--{name}", action="store_true")
    for name in ("fast_mode", "filter_paragraphs", "perform_deduplication", "split_sentences", "reevaluate", "reevaluate_only", "compress_output", "insert_fast_mode_gazetteers", "verbose"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--filter_input", help="wildcard for file names")
    p.add_argument("--thresholds", type=json.loads, default={}, help='JSON with valid_score, ownership_score and usage_score')
    p.add_argument("--lexicon", help="Parquet with rank, phrase and kind; the keyword lists if left out")
    p.add_argument("--dataset_gazetteers", choices=("synthetic", "hybrid"), help="adds a gazetteer of that name")
    p.add_argument("--gazetteer_dir", help="folder with synthetic and hybrid, each Parquet with phrase and types")
    return p


def parsed(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Documents of TEI or PDF files, parsed once and written beside the results; None for the other modes."""
    if a.parquet_mode or a.text_mode:
        return None
    if a.xml_mode:
        docs = readers.tei_documents(spark, a.input_dir, a.filter_input or "*.xml")
    else:
        docs = readers.pdf_documents(spark, a.input_dir, pattern=a.filter_input or "*.pdf")
    docs.write.mode("overwrite").parquet(f"{a.output_dir}/documents")
    return spark.read.parquet(f"{a.output_dir}/documents")


def sentences(spark: SparkSession, a: argparse.Namespace, docs: DataFrame | None) -> DataFrame:
    if docs is not None:
        return segment.sentences_of_sections(docs)
    if a.parquet_mode:
        return segment.sentences_of_sections(readers.parquet_documents(spark, a.input_dir))
    return segment.sentences_of_lists(readers.text_files(spark, a.input_dir, a.filter_input or "*.txt", a.split_sentences), split=a.split_sentences)


def gazetteer(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """``phrase, types`` of the external gazetteer; empty without one."""
    if not a.dataset_gazetteers:
        return spark.createDataFrame([], "phrase string, types array<string>")
    if not a.gazetteer_dir:
        raise ValueError("--dataset_gazetteers needs --gazetteer_dir")
    return spark.read.parquet(f"{a.gazetteer_dir}/{a.dataset_gazetteers}").select("phrase", "types")


def lexicon_of(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = spark.read.parquet(a.lexicon) if a.lexicon else lexicon.keyword_rows(spark)
    if a.dataset_gazetteers:
        rows = rows.unionByName(lexicon.gazetteer_rows(gazetteer(spark, a), offset=1_000_000))
    return rows


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    if a.verbose:
        spark.sparkContext.setLogLevel("INFO")
    if a.reevaluate_only:
        mentions, kept = spark.read.parquet(f"{a.input_dir}/mentions"), f"{a.input_dir}/documents"
        docs = spark.read.parquet(kept) if exists(spark, kept) else None
    else:
        rows, own, docs = lexicon_of(spark, a), None, parsed(spark, a)
        if a.fast_mode:
            writers.write_results(extract_fast(sentences(spark, a, docs), rows), f"{a.output_dir}/fast", a.compress_output)
            return 0
        given = sentences(spark, a, docs)
        if a.insert_fast_mode_gazetteers:
            words = (spark.createDataFrame([(x,) for x in found], "phrase string") for found in (DATA_PHRASES, SOFTWARE_PHRASES))
            own = with_own_entries(given, rows, RuleScorer(), gazetteer(spark, a), *words)
        found = extract(given, rows, filter_paragraphs=a.filter_paragraphs, deduplicate=a.perform_deduplication, own_rows=own)
        found["mentions"].write.mode("overwrite").parquet(f"{a.output_dir}/mentions")
        mentions = spark.read.parquet(f"{a.output_dir}/mentions")
        writers.write_results(found["clusters"].select("doc_id", "mention_id", "type", "label", "cluster", "annotated", "artifact_yes"), f"{a.output_dir}/clusters", a.compress_output)
        report.artifacts(found["clusters"], not a.text_mode).write.mode("overwrite").parquet(f"{a.output_dir}/artifacts")
    if a.reevaluate or a.reevaluate_only:
        t = a.thresholds
        out = reevaluate(mentions, t.get("valid_score", 0.8), t.get("ownership_score", 0.8), t.get("usage_score", 0.8), not a.text_mode, docs)
        if "report" in out:
            writers.write_results(out["report"], f"{a.output_dir}/reevaluated/report", a.compress_output)
        for name in out.keys() - {"clusters", "report"}:
            out[name].write.mode("overwrite").parquet(f"{a.output_dir}/reevaluated/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
