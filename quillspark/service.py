"""Requests of a text-list service: checked body in, status and JSON out. ``serve`` is a plain HTTP front for trials."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.scoring import RuleScorer, Scorer
from quillspark.operators import lexicon, segment
from quillspark.plans.extraction import extract, extract_fast, with_own_entries
from quillspark.sources import readers


def infer_text_list(spark: SparkSession, body: str, rows: DataFrame | None = None, scorer: Scorer | None = None, gazetteers: dict[str, DataFrame] | None = None) -> tuple[int, dict]:
    """Status 200 with the result, 422 for a malformed body. Gazetteers are lexicon rows for hybrid and synthetic."""
    try:
        request = readers.load_request(body)
    except ValueError as e:
        return 422, {"detail": str(e)}
    rows = lexicon.keyword_rows(spark) if rows is None else rows
    extra = (gazetteers or {}).get(request["dataset_gazetteers"])
    rows = rows if extra is None else rows.unionByName(extra)
    if not any(p for p in request["text_list"]):
        return 200, {"text_list": request["text_list"], "research_artifacts": []}
    sentences = segment.sentences_of_lists(readers.text_lists(spark, [request["text_list"]]), split=request["split_sentences"])
    if request["fast_mode"]:
        found = extract_fast(sentences, rows).orderBy("sec", "par").select(F.col("paragraph").alias("Paragraph"), F.col("candidates").alias("Candidates"), F.col("results").alias("Results"))
        return 200, {"text_list": request["text_list"], "research_artifacts": [r.asDict() for r in found.collect()]}
    own = None
    if request["insert_fast_mode_gazetteers"]:
        words = {k: rows.where(F.col("kind") == k).select("phrase") for k in ("dataset", "software")}
        base = rows.where("kind LIKE 'gaz%'").groupBy("phrase").agg(F.collect_set(F.when(F.col("kind") == "gaz_dataset", "Dataset").otherwise("Method")).alias("types"))
        own = with_own_entries(sentences, rows, scorer or RuleScorer(), base, words["dataset"], words["software"])
    out = extract(sentences, rows, scorer, deduplicate=request["perform_deduplication"], own_rows=own)
    mentions = {r.mention_id: r.asDict(recursive=True) for r in out["mentions"].orderBy("cand_no").collect()}
    clusters: dict = {}
    for r in out["clusters"].orderBy("cand_no").collect():
        clusters.setdefault(r.type, {}).setdefault(r.cluster, {}).setdefault(r.label, []).append(r.mention_id)
    return 200, {"text_list": request["text_list"], "research_artifacts": {"candidates_metadata": mentions, "grouped_clusters": clusters}}


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000, **options) -> None:
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            size = int(self.headers.get("Content-Length") or 0)
            status, answer = infer_text_list(spark, self.rfile.read(size).decode() or "{}", **options) if self.path == "/infer_text_list" else (404, {"detail": "unknown path"})
            data = json.dumps(answer).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(data)

    HTTPServer((host, port), Handler).serve_forever()
