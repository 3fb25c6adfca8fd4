"""Registered queries of the engine's own operators, over the whole test tables.

Queries on mentions take a fixture lexicon, since the shipped keywords don't occur in the invented texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import catalog_sql as sql
from quillspark.functions import text as T
from quillspark.functions.scoring import RuleScorer
from quillspark.operators import cascade, dedup, evaluate, lexicon, match, report, segment
from quillspark.plans import extraction
from quillspark.plans.components import connected_components
from quillspark.plans.storage import Workspace, dealt
from quillspark.streaming import event_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = sql.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, d):
    return dealt(_t(spark, d, "documents").select("doc_id", "text"))


def _sentences(spark, d, offsets=False, where=None):
    return segment.sentences_of_texts(_documents(spark, d), offsets=offsets, where=where)


def _lexicon(spark, rows=sql.LEXICON):
    return spark.createDataFrame(rows, lexicon.LEXICON)


def _mentions(spark, d):
    rows = _lexicon(spark, sql.ARTIFACT_LEXICON)
    return cascade.run_cascade(extraction.candidates(_sentences(spark, d, offsets=True, where=match.may_match(rows)), rows), RuleScorer())


def _clusters(spark, d):
    return dedup.deduplicate(_mentions(spark, d))


# lexicons


@query
def lexicon_flatten(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("name"), F.array("p_type", F.concat(F.lit(" "), "p_name")).alias("variants"))
    return lexicon.flatten_datasets(rows)


@query
def lexicon_merge(spark, d):
    p = _t(spark, d, "part")
    methods = lexicon.flatten_methods(p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("full_name")))
    data = lexicon.flatten_datasets(p.select(F.col("p_name").alias("name"), F.array("p_brand").alias("variants")))
    return lexicon.merge(methods, data).select("phrase", F.array_join("types", ",").alias("types"))


@query
def lexicon_noise(spark, d):
    rows = _t(spark, d, "part").select(F.col("p_size").cast("string").alias("phrase")).distinct()
    return lexicon.without_noise(rows, ("0", ".", "2048", "7", "11"))


def _snippets(spark, d):
    docs = _t(spark, d, "documents")
    first = F.regexp_extract("text", r"^(\S+)", 1)
    kind = F.element_at(F.array(*map(F.lit, ("Dataset", "Software", "repository", "Method"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs.select(F.concat(F.lit("A <m>"), first, F.lit("</m> here")).alias("Snippet"), kind.alias("Type"), F.when(F.col("doc_id") % 3 == 0, "No").otherwise("Yes").alias("Valid"))


@query
def lexicon_from_tags(spark, d):
    return lexicon.from_annotated(_snippets(spark, d))


@query
def lexicon_new_entries(spark, d):
    entries = lexicon.from_annotated(_snippets(spark, d))
    base = entries.where(F.length("phrase") > 6).groupBy("phrase").agg(F.collect_set("type").alias("types"))
    words = spark.createDataFrame([("The",), ("And",)], "phrase string")
    return lexicon.new_entries(entries, base, words, words.where("phrase = 'And'"))


def _answers(spark, d):
    first, last = F.regexp_extract("text", r"^(\S+)", 1), F.regexp_extract("text", r"(\S+)$", 1)
    made = F.concat(F.lit("dataset : "), first, F.lit(" | software: "), last, F.lit(" | N/A | a : b : c | method : x | software :  "))
    return _t(spark, d, "documents").select("doc_id", F.when(F.col("lang") == "es", "N/A").otherwise(made).alias("answer"))


@query
def parse_answers(spark, d):
    return _answers(spark, d).select("doc_id", F.explode(T.parse_answer("answer")).alias("x")).select("doc_id", "x.type", "x.name")


@query
def lexicon_dynamic(spark, d):
    return lexicon.from_answers(_answers(spark, d))


# segmentation


@query
def paragraphs(spark, d):
    return segment.paragraphs(_t(spark, d, "documents"))


@query
def sentences(spark, d):
    return _sentences(spark, d).select("doc_id", "par", "sent", "text")


@query
def snippet_offsets(spark, d):
    return segment.with_offsets(_sentences(spark, d)).select("doc_id", "par", "sent", "snippet_start", "snippet_end")


@query
def paragraph_offsets(spark, d):
    return segment.paragraph_texts(_sentences(spark, d)).select("doc_id", "par", "paragraph_start", "paragraph_end", F.md5("paragraph").alias("paragraph_md5"))


@query
def section_text(spark, d):
    return segment.section_texts(_sentences(spark, d)).select("doc_id", F.md5("section").alias("section_md5"))


@query
def abstract_first(spark, d):
    sections = F.transform(F.split("text", "\n"), lambda x: F.struct(F.when(F.length(x) % 5 == 0, "Abstract").otherwise(F.substring(x, 1, 8)).alias("title"), F.array(F.array(x)).alias("paragraphs")))
    moved = _t(spark, d, "documents").select("doc_id", sections.alias("sections")).select("doc_id", segment.abstract_first().alias("s"))
    return moved.select("doc_id", F.array_join(F.transform("s", lambda x: x["title"]), "|").alias("titles"))


# matching


@query
def contains_bool(spark, d):
    s = _sentences(spark, d)
    return s.groupBy("doc_id").agg(*(F.count_if(match.contains(F.col("text"), F.lit(p))).alias(n) for n, p in (("n_license", "License"), ("n_version", "VERSION"), ("n_of", "of th"))))


@query
def match_spans(spark, d):
    return match.match_lexicon(_sentences(spark, d), _lexicon(spark)).select("doc_id", "par", "sent", "kind", "phrase", "start", "end")


@query
def mention_counts(spark, d):
    found = match.match_lexicon(_sentences(spark, d), _lexicon(spark))
    return found.groupBy("kind", "phrase").agg(F.count(F.lit(1)).alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))


@query
def match_ids(spark, d):
    return match.number_candidates(match.match_lexicon(_sentences(spark, d), _lexicon(spark))).select("doc_id", "mention_id", "type", "kind", "phrase", "par", "sent", "start")


@query
def annotated_mentions(spark, d):
    found = match.annotated(match.match_lexicon(_sentences(spark, d), _lexicon(spark, sql.ARTIFACT_LEXICON)))
    return found.select("doc_id", "par", "sent", "kind", "phrase", "start", "annotated")


@query
def paragraph_type_groups(spark, d):
    found = match.annotated(match.number_candidates(match.match_lexicon(_sentences(spark, d), _lexicon(spark, sql.ARTIFACT_LEXICON))))
    return match.by_paragraph(found).select("doc_id", "par", "type", F.array_join("annotated", "|").alias("annotated"))


@query
def candidate_counts(spark, d):
    found = match.match_lexicon(_sentences(spark, d), _lexicon(spark))
    return cascade.paragraph_counts(found).select("doc_id", "par", "kind", "n")


@query
def annotated_copies(spark, d):
    copies = F.posexplode(T.annotated_copies("text", F.lit("License"))).alias("i", "copy")
    return _sentences(spark, d).where(F.col("text").contains("License")).select("doc_id", "par", "sent", copies)


# text functions


def _cited(spark, d):
    return _documents(spark, d).select("doc_id", F.concat("text", F.lit(sql.CITED)).alias("text"))


@query
def citations(spark, d):
    c = _cited(spark, d).select("doc_id", "text", T.find_citations("text").alias("c"))
    return c.select("doc_id", *(F.array_join(f"c.{n}", "|").alias(n) for n in T.CITATION_PATTERNS), T.has_citations("text").alias("has"))


def _url_texts(spark, d):
    return _t(spark, d, "pages").select("page_id", F.concat(F.lit("See "), "url", F.lit(sql.URL_TAIL), F.col("page_id").cast("string"), F.lit(".")).alias("text"))


@query
def urls(spark, d):
    return _url_texts(spark, d).select("page_id", F.array_join(T.find_urls("text"), "|").alias("urls"))


@query
def code_host_urls(spark, d):
    return _url_texts(spark, d).select("page_id", F.array_join(T.find_urls("text", code_hosts_only=True), "|").alias("urls"))


@query
def url_filter(spark, d):
    parts = F.explode(F.split("url", "[/?]+")).alias("part")
    numbered = _t(spark, d, "pages").select("page_id", parts)
    return numbered.select("page_id", "part", T.is_url("part").alias("is_url")).distinct()


@query
def prompts(spark, d):
    return _sentences(spark, d).select("doc_id", "par", "sent", F.md5(T.make_prompt("text", T.question("name", F.lit("dataset")))).alias("prompt_md5"))


@query
def section_titles(spark, d):
    words = segment.paragraphs(_t(spark, d, "documents")).select("doc_id", "par", F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("Background", "Related", "Relatedness", "On", ""))), (F.col("par") % 5 + 1)), "text").alias("title"))
    return words.select("doc_id", "par", T.is_valid_section_title("title").alias("valid"))


@query
def acronyms(spark, d):
    return segment.paragraphs(_documents(spark, d)).select("doc_id", "par", T.acronym("text").alias("acronym"))


@query
def acronym_match(spark, d):
    names = _t(spark, d, "customer").select(F.concat("c_mktsegment", F.lit(" ("), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit(") "), "c_name").alias("name"))
    short = F.upper(F.substring("name", 1, 3))
    return names.select("name", T.contains_acronym("name", short).alias("contained"), T.is_acronym(short).alias("is_acronym"), (T.acronym("name") == F.lit("A(C")).alias("abbreviates"))


@query
def distinct_in_order(spark, d):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    return _t(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_distinct(ordered), "|").alias("types"))


@query
def choice_shares(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("value") % 5).alias("x"))
    logits = F.array(F.array(*(F.struct(F.lit(t).alias("token"), v.alias("logit")) for t, v in (("Yes", F.col("x")), ("No", F.lit(1.0)), ("Yes", F.lit(0.5)), ("Maybe", F.lit(9.0))))))
    return e.select("event_id", F.round(T.classify_logits(logits, ["Yes", "No"])["Yes"], 6).alias("p_yes"))


# cascade


@query
def fast_mode(spark, d):
    rows = extraction.extract_fast(_sentences(spark, d), _lexicon(spark))
    return rows.select("doc_id", "par", "candidates", "results")


@query
def paragraph_filter(spark, d):
    found = match.number_candidates(match.match_lexicon(_sentences(spark, d), _lexicon(spark, sql.ARTIFACT_LEXICON)))
    answers = found.select("doc_id", "sec", "par").distinct().withColumn("answer", F.when(F.col("par") % 3 == 0, "N/A").when(F.col("par") % 3 == 1, "dataset : x | other : y").otherwise("software : z"))
    return cascade.relevant_paragraphs(found, answers).select("doc_id", "mention_id", "type", "skipped")


@query
def validity_cascade(spark, d):
    return _mentions(spark, d).select("doc_id", "mention_id", "artifact_yes", "valid", "name", "license", "version", "url", "ownership_yes", "ownership", "reuse_yes", "reuse")


@query
def name_blanking(spark, d):
    words = _t(spark, d, "part").select("p_partkey", F.element_at(F.array(*map(F.lit, (" Dataset", "model ", "BIOMRC", "Corpus x", "APIs"))), (F.col("p_partkey") % 5 + 1).cast("int")).alias("name"))
    return words.select("p_partkey", T.or_missing(cascade.without_keyword_names(F.col("name"))).alias("name"))


@query
def new_thresholds(spark, d):
    return cascade.apply_thresholds(_mentions(spark, d), 0.6, 0.5, 0.8).select("doc_id", "mention_id", "artifact_yes", "ownership", "reuse")


# dedup


@query
def name_groups(spark, d):
    return dedup.name_groups(_mentions(spark, d).where("valid")).select("doc_id", "type", "name", "first", "n")


@query
def name_pairs(spark, d):
    return dedup.name_pairs(dedup.name_groups(_mentions(spark, d).where("valid")))


def _cited_mentions(spark, d):
    """Mentions of license names in sentences with citation marks."""
    s = _sentences(spark, d, where=lambda text: text.contains("License")).where(F.col("text").contains("License"))
    s = s.withColumn("text", F.concat("text", F.lit(sql.MARKS)))
    found = cascade.run_cascade(extraction.candidates(s, _lexicon(spark, sql.ARTIFACT_LEXICON)), RuleScorer()).where("valid")
    return Workspace(spark, "cited").save(found)


@query
def closest_citations(spark, d):
    return dedup.closest_citation(_cited_mentions(spark, d))


@query
def citation_of_name(spark, d):
    return dedup.citation_of_name(dedup.closest_citation(_cited_mentions(spark, d)))


@query
def citation_edges(spark, d):
    m = _cited_mentions(spark, d)
    groups = dedup.group_names(dedup.name_groups(m))
    return dedup.citation_edges(groups, dedup.citation_of_name(dedup.closest_citation(m)))


@query
def acronym_edges(spark, d):
    c = _t(spark, d, "customer")
    long = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.lit("dataset").alias("type"), F.concat("c_mktsegment", F.lit(" Data "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("first"), F.lit(1).cast("long").alias("n"))
    short = c.select(F.col("c_nationkey").cast("long").alias("doc_id"), F.lit("dataset").alias("type"), F.substring("c_mktsegment", 1, 9).alias("name"), (F.col("c_custkey") + 1_000_000_000).alias("first"), F.lit(2).cast("long").alias("n"))
    short = short.groupBy("doc_id", "type", "name", "n").agg(F.min("first").alias("first")).select("doc_id", "type", "name", "first", "n")
    return dedup.acronym_edges(dedup.group_names(long.unionByName(short)))


@query
def components(spark, d):
    """Customers (their keys) and their orders (numbers below zero): every order is an edge."""
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("u"), (-1 - F.col("o_orderkey")).alias("v"))
    return connected_components(o).select("node", "component")


@query
def merged_groups(spark, d):
    m = _cited_mentions(spark, d)
    groups = dedup.group_names(dedup.name_groups(m))
    return dedup.merge_groups(groups, dedup.citation_edges(groups, dedup.citation_of_name(dedup.closest_citation(m)))).select("doc_id", "type", "name", "grp")


@query
def clusters(spark, d):
    return _clusters(spark, d).select("doc_id", "mention_id", "type", "label", "cluster")


# reports


@query
def artifact_report(spark, d):
    return report.artifacts(_clusters(spark, d))


@query
def license_shares(spark, d):
    m = _clusters(spark, d).withColumn("at", F.col("cand_no"))
    return report.shares(m, "license", ["type", "label"]).select("type", "label", "value", "n", F.round("pct", 6).alias("pct"))


@query
def url_shares(spark, d):
    u = _url_texts(spark, d).select("page_id", F.explode(T.find_urls("text")).alias("u")).select(F.regexp_extract("u", r"^(?:https?://)?([^/?#:]+)", 1).alias("host"), F.regexp_extract("u", r"^(https?)", 1).alias("scheme"), F.col("page_id").alias("at"))
    return report.shares(u, "host", ["scheme"]).select("scheme", "value", "n", F.round("pct", 6).alias("pct"))


@query
def mentions_table(spark, d):
    return report.mention_rows(_clusters(spark, d))


@query
def citations_table(spark, d):
    o = _t(spark, d, "orders")
    author = F.array(F.struct(F.col("o_orderpriority").alias("surname"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus")).alias("forename")))
    rows = o.select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 5).alias("ref_ord"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("doi"), F.col("o_orderstatus").alias("title"), F.when(F.col("o_custkey") % 3 != 0, author).alias("authors"))
    return report.citations(rows)


@query
def citances_table(spark, d):
    li = _t(spark, d, "lineitem")
    target = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("#b"), F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") == 2, F.concat(F.lit("#fig_"), F.col("l_suppkey").cast("string"))).when(F.col("l_linenumber") == 3, F.lit("other"))
    refs = F.array(F.struct(target.alias("target"), F.col("l_returnflag").alias("type"), F.lit(None).cast("string").alias("text")))
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("sec_idx"), F.lit(0).alias("par_idx"), F.lit(1).alias("s_idx"), F.col("l_linestatus").alias("sentence"), refs.alias("refs"))
    return report.citances(rows).select("doc_id", "sec_idx", "target", "type", "text", "intent", F.col("key.name").alias("key_name"), F.col("key.number").alias("key_number"))


@query
def simple_lists(spark, d):
    a = report.artifacts(_clusters(spark, d))
    return a.select("doc_id", "type", "label", report.simple_lines(F.col("licenses")).alias("licenses"), report.simple_lines(F.col("versions")).alias("versions"))


# evaluation


def _graded(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return docs.select("doc_id", "lang", (F.length("text") < 600).alias("p"), (F.col("quality") == 0).alias("g"), F.substring("text", 1, 3).alias("a"), T.simple_upper(F.substring("text", 2, 3)).alias("b"))


@query
def eval_binary(spark, d):
    return evaluate.binary_scores(_graded(spark, d), F.col("p"), F.col("g"), ["lang"])


@query
def eval_match(spark, d):
    rows = _graded(spark, d).withColumn("b", F.when(F.col("doc_id") % 2 == 0, T.simple_lower("a")).otherwise(F.col("b")))
    return evaluate.match_rates(rows, "a", "b", T.simple_lower)


@query
def eval_errors(spark, d):
    return evaluate.match_errors(_graded(spark, d), "doc_id", "a", "b", T.simple_lower)


@query
def eval_offsets(spark, d):
    s = match.annotated(match.match_lexicon(_sentences(spark, d), _lexicon(spark, sql.ARTIFACT_LEXICON)))
    o = evaluate.derive_offsets(F.col("annotated"))
    return s.select("doc_id", "par", "sent", "kind", o["start"].alias("start"), o["end"].alias("end"), F.md5(o["text"]).alias("text_md5"))


@query
def top_terms(spark, d):
    words = _t(spark, d, "documents").select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("term")).where("term != ''")
    counted = words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))
    return counted.withColumn("rank", rank).where("rank <= 10")


@query
def event_windows(spark, d):
    w = event_counts(_t(spark, d, "events"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("value", 2).alias("value"))
