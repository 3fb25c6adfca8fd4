"""Sinks: JSON for each document, and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.report import simple_lines


def write_results(mentions: DataFrame, path: str, compress: bool = False, folders: bool = False) -> None:
    """JSON lines, gzipped or not; a document's rows are in one file. With ``folders`` each document has its own: for
    few documents, since a corpus would end in as many folders."""
    dealt = mentions.repartition("doc_id")
    writer = (dealt.write.partitionBy("doc_id") if folders else dealt.write).mode("overwrite")
    writer.json(path, compression="gzip" if compress else "none")


def report_json(publication: DataFrame, artifacts: DataFrame, mentions: DataFrame, citations: DataFrame, citances: DataFrame) -> DataFrame:
    """``doc_id, report``: the five tables of each document as one JSON text."""
    out = publication.select("doc_id", F.struct(*(c for c in publication.columns if c != "doc_id")).alias("publication_info"))
    for name, table in (("research_artifacts", artifacts), ("mentions", mentions), ("citations", citations), ("citances", citances)):
        rows = F.array_sort(F.collect_list(F.struct(*(c for c in table.columns if c != "doc_id"))))
        out = out.join(table.groupBy("doc_id").agg(rows.alias(name)), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct(*(c for c in out.columns if c != "doc_id"))).alias("report"))


def workbook_ids(artifacts: DataFrame) -> DataFrame:
    """Adds ``row_id``: A1, A2, … in a document, by type, cluster and name: the targets of links between sheets."""
    order = Window.partitionBy("doc_id").orderBy("type", "display", "label")
    return artifacts.withColumn("row_id", F.concat(F.lit("A"), F.row_number().over(order)))


def linked_mentions(mentions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Adds to mention rows the first artifact row with their name and cluster."""
    rows = workbook_ids(artifacts).groupBy("doc_id", "display", F.col("label").alias("artifact")).agg(F.min_by("row_id", F.substring("row_id", 2, 12).cast("int")).alias("row_id"))
    return mentions.join(rows, ["doc_id", "display", "artifact"], "left")


def curator_view(artifacts: DataFrame) -> DataFrame:
    """The short table for curators: owned or reused artifacts with plain lists."""
    lists = ("licenses", "versions", "urls", "citations")
    return artifacts.where("owned = 'Yes' OR reused = 'Yes'").select("doc_id", F.col("label").alias("artifact"), "type", "owned", "reused", *(simple_lines(F.col(c)).alias(c) for c in lists), "mentions_count")


def write_workbook(tables: dict[str, DataFrame], path: str) -> None:
    """One xlsx sheet for each table, if openpyxl is installed; meant for the report of a single document."""
    import pandas as pd

    with pd.ExcelWriter(path, engine="openpyxl") as writer:
        for name, table in tables.items():
            table.toPandas().to_excel(writer, sheet_name=name, index=False)
