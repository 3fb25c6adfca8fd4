"""Readers: texts, lists, nested documents, TEI XML, gazetteers and earlier results."""

from __future__ import annotations

import ast
import json
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECTIONS = "array<struct<title:string,paragraphs:array<array<string>>>>"
DOCUMENT = f"""doc_id string, identifiers array<struct<type:string,text:string>>, title string, abstract array<array<string>>, sections {SECTIONS},
bibl_references array<struct<id:string,doi:string,title:string,authors:array<struct<surname:string,forename:string>>>>,
figures array<struct<id:string,head:string,desc:string>>, formulas array<struct<id:string,desc:string>>,
citances array<struct<sec_idx:int,par_idx:int,s_idx:int,refs:array<struct<target:string,type:string,text:string>>,sentence:string>>"""

#: Environment variable and path of a GROBID service.
GROBID_VARIABLE, GROBID_PATH = "GROBID_URL", "/api/processFulltextDocument"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.json|\.xml|\.txt|\.pdf|\.parquet)?(?:\.gz)?$", 1)


def text_files(spark: SparkSession, path: str, pattern: str | None = None, split: bool = False) -> DataFrame:
    """``doc_id, text_list``: one document for each file that fits the pattern. Without split the file is a single
    paragraph of its lines, line feeds kept; with split every line is a paragraph, still to be split."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    raw = reader.text(path, wholetext=True).select(file_name(F.input_file_name()).alias("doc_id"), F.col("value"))
    lines = F.regexp_extract_all("value", F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0))
    listed = F.transform(lines, lambda x: F.array(F.rtrim(F.regexp_replace(x, r"\n$", "")))) if split else F.array(lines)
    return raw.select("doc_id", listed.alias("text_list"))


def text_lists(spark: SparkSession, lists: list[list[list[str]]]) -> DataFrame:
    """Documents given in memory as paragraphs of sentences, numbered from 0."""
    return spark.createDataFrame([(str(i), x) for i, x in enumerate(lists)], "doc_id string, text_list array<array<string>>")


def parquet_documents(spark: SparkSession, path: str, id_col: str = "id", sections_col: str = "sections") -> DataFrame:
    """``doc_id, sections``. Sections may be nested or a text with a literal; literals are parsed, never evaluated."""
    df = spark.read.parquet(path)
    found = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(sections_col).alias("sections"))
    if found.schema["sections"].dataType.simpleString() != "string":
        return found.select("doc_id", F.col("sections").cast(SECTIONS))
    return found.mapInPandas(_literals, f"doc_id string, sections {SECTIONS}")


def _literals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def parse(text):
        try:
            value = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError):
            return None
        return [{"title": s[0], "paragraphs": s[1]} for s in value]

    for df in frames:
        yield df.assign(sections=df["sections"].map(parse))


def doi_documents(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, sections`` of JSON rows with doi and sections as (title, paragraphs) pairs or structs."""
    raw = spark.read.schema("doi string, sections string").json(path)
    pairs = F.from_json("sections", "array<array<string>>")
    nested = F.transform(pairs, lambda s: F.struct(F.get(s, F.lit(0)).alias("title"), F.from_json(F.get(s, F.lit(1)), "array<array<string>>").alias("paragraphs")))
    return raw.select(F.col("doi").alias("doc_id"), F.coalesce(F.from_json("sections", SECTIONS), nested).alias("sections"))


def gazetteer_methods(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, full_name string").option("multiLine", True).json(path)


def gazetteer_datasets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, variants array<string>").option("multiLine", True).json(path)


def annotated_snippets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("Snippet string, Type string, Valid string").option("multiLine", True).json(path)


def phrase_list(spark: SparkSession, path: str) -> DataFrame:
    """``phrase``: stripped lines."""
    return spark.read.text(path).select(F.trim("value").alias("phrase")).where("phrase != ''")


def results(spark: SparkSession, path: str, pattern: str = "*.json*") -> DataFrame:
    """Mention tables of earlier runs, as ``write_results`` leaves them."""
    return spark.read.option("pathGlobFilter", pattern).json(path)


def tei_documents(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """Parsed documents of TEI files; a file that is no XML gives a row of nulls."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return parse_tei(raw.select(file_name(F.col("path")).alias("doc_id"), "content"))


def parse_tei(raw: DataFrame) -> DataFrame:
    """Parsed documents of (doc_id, content)."""
    return raw.mapInPandas(_parse_frames, DOCUMENT)


def pdf_documents(spark: SparkSession, path: str, fetch: Callable[[bytes], bytes] | None = None, pattern: str = "*.pdf") -> DataFrame:
    """Parsed documents of PDF files, through a parser service; ``fetch`` gives TEI for the bytes of a PDF."""
    fetch = fetch or grobid(os.environ.get(GROBID_VARIABLE, "http://localhost:8070"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            yield df.assign(content=df["content"].map(fetch))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(file_name(F.col("path")).alias("doc_id"), "content")
    return parse_tei(raw.mapInPandas(run, "doc_id string, content binary"))


#: Form fields of a parse request.
GROBID_FIELDS = {"consolidateHeader": "1", "consolidateCitations": "0", "includeRawCitations": "1", "includeRawAffiliations": "1", "teiCoordinates": "s", "segmentSentences": "1"}


def grobid(url: str, timeout: float = 300) -> Callable[[bytes], bytes]:
    def fetch(pdf: bytes) -> bytes:
        import urllib.request
        import uuid

        edge = uuid.uuid4().hex
        parts = [f'--{edge}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in GROBID_FIELDS.items()]
        parts.append(f'--{edge}\r\nContent-Disposition: form-data; name="input"; filename="input.pdf"\r\nContent-Type: application/pdf\r\n\r\n'.encode() + pdf + b"\r\n")
        request = urllib.request.Request(url.rstrip("/") + GROBID_PATH, b"".join(parts) + f"--{edge}--\r\n".encode(), {"Content-Type": f"multipart/form-data; boundary={edge}"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()

    return fetch


def _parse_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in frames:
        rows = [tei_document(doc, bytes(content)) for doc, content in zip(df["doc_id"], df["content"], strict=True)]
        yield pd.DataFrame(rows)


def tei_document(doc_id: str, content: bytes) -> dict:
    """The parts of a TEI file. Element names count without their namespaces; missing parts are null or empty."""
    blank = {"doc_id": doc_id, "identifiers": None, "title": None, "abstract": None, "sections": None, "bibl_references": None, "figures": None, "formulas": None, "citances": None}
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return blank
    above = {child: parent for parent in root.iter() for child in parent}

    def tag(e) -> str:
        return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""

    def every(e, name: str) -> list:
        return [x for x in e.iter() if x is not e and tag(x) == name]

    def first(e, name: str):
        return next(iter(every(e, name)), None)

    def text(e) -> str | None:
        return None if e is None else "".join(e.itertext())

    def attribute(e, name: str) -> str | None:
        return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)

    def title_of(div, content) -> str | None:
        head = next((x for x in div if tag(x) == "head"), None)
        if head is not None or not content or not content[0]:
            return text(head)
        at = div
        for kind in ("figure", "table", "graphic"):
            at = div
            while at is not None and tag(at) != kind:
                at = above.get(at)
            if at is not None:
                return text(first(at, "head")) or kind
        return None

    def authors(e) -> list[dict] | None:
        return [{"surname": text(first(a, "surname")), "forename": text(first(a, "forename"))} for a in every(e, "author")] or None

    def reference(e) -> dict:
        doi = next((text(x) for x in every(e, "idno") if attribute(x, "type") == "DOI"), None)
        return {"id": attribute(e, "id"), "doi": doi and doi.lower(), "title": text(first(e, "title")), "authors": authors(e)}

    source, about = first(root, "sourceDesc"), first(root, "abstract")
    divs = every(root, "div")
    sections, cited = [], []
    for sec, div in enumerate(divs):
        body = [[(s, text(s)) for s in every(p, "s")] for p in every(div, "p")]
        sections.append({"title": title_of(div, body), "paragraphs": [[t for _, t in p] for p in body]})
        for par, p in enumerate(body):
            for at, (s, sentence) in enumerate(p):
                refs = [{"target": attribute(r, "target"), "type": attribute(r, "type"), "text": text(r)} for r in every(s, "ref")]
                if refs:
                    cited.append({"sec_idx": sec, "par_idx": par, "s_idx": at, "refs": refs, "sentence": sentence})
    return {
        "doc_id": doc_id, "identifiers": None if source is None else [{"type": attribute(x, "type"), "text": text(x)} for x in every(source, "idno")],
        "title": text(first(root, "title")), "abstract": None if about is None else [[text(s) for s in every(p, "s")] for p in every(about, "p")], "sections": sections,
        "bibl_references": [reference(x) for x in every(root, "biblStruct")], "citances": cited,
        "figures": [{"id": attribute(x, "id"), "head": text(first(x, "head")), "desc": text(first(x, "figDesc"))} for x in every(root, "figure")],
        "formulas": [{"id": attribute(x, "id"), "desc": text(x)} for x in every(root, "formula")],
    }


def load_request(text: str) -> dict:
    """A request of the text-list service: the lists and its flags, checked; a ValueError tells what is wrong."""
    body = json.loads(text)
    flags = ("fast_mode", "perform_deduplication", "insert_fast_mode_gazetteers", "split_sentences")
    lists = body.get("text_list")
    if not isinstance(lists, list) or not all(isinstance(p, list) and all(isinstance(s, str) for s in p) for p in lists):
        raise ValueError("text_list must be a list of lists of strings")
    out = {"text_list": lists, "dataset_gazetteers": body.get("dataset_gazetteers")}
    if out["dataset_gazetteers"] not in (None, "hybrid", "synthetic"):
        raise ValueError("dataset_gazetteers must be hybrid, synthetic or null")
    for name in flags:
        out[name] = body.get(name, False)
        if not isinstance(out[name], bool):
            raise ValueError(f"{name} must be a boolean")
    return out
