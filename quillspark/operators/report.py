"""Reports: artifacts, mentions, citations, citances and publication rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import all_citations, cluster_display_name, is_valid_section_title

ARTIFACT = ["doc_id", "type", "cluster", "label"]


def _yes_mean(p: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(p) >= 0.5, F.col(p))), F.lit(0.0))


def shares(rows: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Values of each artifact with their share: ``value, n, pct``, and ``at`` (the first mention that has it)."""
    keys = keys or ARTIFACT
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    total = counted.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counted.join(total, keys).withColumn("pct", F.col("n") / F.col("total") * 100).drop("total")


def listed(share: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Values as lines of ``value (pct%)`` in the order of their first mention."""
    keys = keys or ARTIFACT
    line = F.concat("value", F.lit(" ("), F.col("pct").cast("string"), F.lit("%)"))
    ordered = F.array_sort(F.collect_list(F.struct("at", line.alias("line"))))
    return share.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias(name))


def artifacts(mentions: DataFrame, by_section: bool = True) -> DataFrame:
    """One row for each artifact of ``deduplicate``, with scores, ownership by its first mention in a valid section
    (in any place with by_section off), reuse by any mention, and the shares of licenses, versions, URLs and citations."""
    fits = is_valid_section_title("title") if by_section else F.lit(True)
    order = F.struct("sec", "par", "sent", "cand_no")
    owner = F.min(F.when(fits, F.struct(order.alias("o"), F.col("ownership").alias("a"))))
    base = mentions.groupBy(*ARTIFACT).agg(
        F.avg("artifact_yes").alias("score"), owner.alias("owner"), F.max((F.col("reuse") == "Yes").cast("int")).alias("reuse"), F.count(F.lit(1)).alias("mentions"),
        F.count_if(F.col("reuse") == "Yes").alias("n_reuse"), _yes_mean("ownership_yes").alias("owned_score"), _yes_mean("reuse_yes").alias("reused_score"),
    )
    owned = F.coalesce(F.col("owner.a") == "Yes", F.lit(False))
    out = base.select(
        *ARTIFACT, cluster_display_name("type", "cluster").alias("display"), F.round("score", 6).alias("score"), F.when(owned, "Yes").otherwise("No").alias("owned"),
        F.round(owned.cast("int") / F.col("mentions") * 100, 6).alias("owned_pct"), F.round("owned_score", 6).alias("owned_score"), F.when(F.col("reuse") == 1, "Yes").otherwise("No").alias("reused"),
        F.round(F.col("n_reuse") / F.col("mentions") * 100, 6).alias("reused_pct"), F.round("reused_score", 6).alias("reused_score"), F.col("mentions").alias("mentions_count"),
    )
    at = F.struct(F.col("cand_no").alias("c"), F.lit(0).alias("i")).alias("at")
    single = mentions.select(*ARTIFACT, at, "license", "version")
    spread = lambda values: mentions.select(*ARTIFACT, "cand_no", F.posexplode(values).alias("i", "v")).select(*ARTIFACT, F.struct(F.col("cand_no").alias("c"), "i").alias("at"), "v")
    columns = {"licenses": (single, "license"), "versions": (single, "version"), "urls": (spread(F.col("urls")), "v"), "citations": (spread(all_citations("citations")), "v")}
    for name, (rows, value) in columns.items():
        out = out.join(listed(shares(rows, value), name), ARTIFACT, "left").fillna("", [name])
    return out


def mention_rows(mentions: DataFrame) -> DataFrame:
    """One row for each mention, with its annotated text; missing answers are empty."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    marks = F.array_join(F.array_sort(F.array_distinct(all_citations("citations"))), "\n")
    return mentions.select(
        "doc_id", "mention_id", cluster_display_name("type", "cluster").alias("display"), F.col("label").alias("artifact"), "kind", "artifact_yes", F.when(F.col("ownership_yes") >= 0.5, "Yes").otherwise("No").alias("owned"),
        "ownership_yes", F.when(F.col("reuse_yes") >= 0.5, "Yes").otherwise("No").alias("reused"), "reuse_yes", blank("license"), blank("version"), F.array_join("urls", "\n").alias("urls"), marks.alias("citations"),
        blank("title"), "sec", "par", "sent", F.col("phrase").alias("trigger"), "annotated",
    )


def simple_lines(value: Column) -> Column:
    """Lines without their trailing `` (pct%)``."""
    return F.array_join(F.transform(F.split(value, "\n"), lambda x: F.regexp_replace(x, r" [^ ]*$", "")), "\n")


def citations(bibliography: DataFrame) -> DataFrame:
    """References but the first (the paper itself), by number; missing parts are empty. Sort by ``number``."""
    author = F.transform("authors", lambda a: F.concat(F.when(F.coalesce(a["forename"], F.lit("")) != "", F.concat(a["forename"], F.lit(" "))).otherwise(""), F.coalesce(a["surname"], F.lit(""))))
    number = F.regexp_replace("id", "b", "").cast("int")
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return bibliography.where("ref_ord > 0").select("doc_id", number.alias("number"), text("id"), text("doi"), text("title"), F.coalesce(F.array_join(author, "\n"), F.lit("")).alias("authors"))


def citance_key(target: Column) -> Column:
    """Order of targets: ``name_7`` by name and number, ``#b7`` by number, others first."""
    parts = F.split(target, "_")
    other = F.when(target.contains("#b"), F.regexp_replace(target, "#b", "").try_cast("int")).otherwise(-1)
    return F.when(target.contains("_"), F.struct(F.get(parts, F.lit(0)).alias("name"), F.get(parts, F.lit(1)).try_cast("int").alias("number"))).otherwise(F.struct(F.lit("").alias("name"), other.alias("number")))


def citances(rows: DataFrame) -> DataFrame:
    """One row for each reference in a sentence; intent, polarity and semantics are Skipped where not given, and so are
    their scores, which are taken from the map of probabilities."""
    ref = rows.select("doc_id", "sec_idx", "par_idx", "s_idx", "sentence", F.explode("refs").alias("r"))
    fields = ref.schema["r"].dataType.fieldNames()
    extra = [(F.coalesce(F.col(f"r.{x}"), F.lit("")) if x in fields else F.lit("Skipped")).alias(x) for x in ("intent", "polarity", "semantics")]
    for x in ("intent", "polarity", "semantics"):
        given = x in fields and f"{x}_probs" in fields
        score = F.coalesce(F.try_element_at(f"r.{x}_probs", f"r.{x}").cast("string"), F.lit("")) if given else F.lit("Skipped")
        extra.append(score.alias(f"{x}_score"))
    target = F.coalesce(F.col("r.target"), F.lit(""))
    return ref.select("doc_id", target.alias("target"), F.coalesce(F.col("r.type"), F.lit("")).alias("type"), "sec_idx", "par_idx", "s_idx", F.coalesce(F.col("r.text"), F.lit("")).alias("text"), *extra, F.coalesce("sentence", F.lit("")).alias("sentence"), citance_key(target).alias("key"))


def citances_with_references(citance_rows: DataFrame, citation_rows: DataFrame) -> DataFrame:
    """Citances with the reference their target ``#bN`` names."""
    refs = citation_rows.select("doc_id", F.col("id").alias("ref_id"), F.col("title").alias("ref_title"))
    hit = F.substring("target", 2, 1_000_000)
    return citance_rows.withColumn("ref_id", F.when(F.col("target").startswith("#"), hit)).join(refs, ["doc_id", "ref_id"], "left")


def publication(documents: DataFrame) -> DataFrame:
    """One row for each parsed document: joined identifiers, title, authors of its first reference, abstract, titles."""
    join = lambda x, sep="\n": F.coalesce(F.array_join(x, sep), F.lit(""))
    name = lambda a: F.concat(F.when(F.coalesce(a["forename"], F.lit("")) != "", F.concat(a["forename"], F.lit(" "))).otherwise(""), F.coalesce(a["surname"], F.lit("")))
    first = F.try_element_at("bibl_references", F.lit(1))
    return documents.select(
        "doc_id", join(F.transform("identifiers", lambda i: F.concat(F.coalesce(i["type"], F.lit("")), F.lit(": "), F.coalesce(i["text"], F.lit(""))))).alias("identifiers"), F.coalesce("title", F.lit("")).alias("title"),
        join(F.transform(first["authors"], name)).alias("authors"), join(F.flatten("abstract"), " ").alias("abstract"), join(F.filter(F.transform("sections", lambda s: s["title"]), lambda t: t.isNotNull() & (t != ""))).alias("sections"),
        *(F.lit("Skipped").alias(x) for x in ("claim", "claimer", "topic", "fos_1", "fos_2", "fos_3")),
    )


def document_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """``publication_info, citations, citances`` of parsed documents."""
    references = documents.select("doc_id", F.posexplode("bibl_references").alias("ref_ord", "r")).select("doc_id", "ref_ord", "r.*")
    sentences = documents.select("doc_id", F.inline("citances"))
    return {"publication_info": publication(documents), "citations": citations(references), "citances": citances(sentences)}


def fast_rows(paragraph_rows: DataFrame, candidates: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``doc_id, sec, par, paragraph, candidates, results``: the distinct candidates of each paragraph in order."""
    line = F.concat(F.lit("["), "type", F.lit("] : "), "phrase")
    ordered = F.array_sort(F.collect_list(F.struct("cand_no", line.alias("line"))))
    found = candidates.groupBy("doc_id", "sec", "par").agg(F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["line"])), " | ").alias("candidates"))
    out = paragraph_rows.select("doc_id", "sec", "par", "paragraph").join(found, ["doc_id", "sec", "par"], "left").fillna("", ["candidates"])
    if answers is None:
        return out.withColumn("results", F.when(F.col("candidates") == "", "N/A").otherwise(F.replace(F.replace("candidates", F.lit("["), F.lit("")), F.lit("]"), F.lit(""))))
    return out.join(answers.select("doc_id", "sec", "par", F.col("answer").alias("results")), ["doc_id", "sec", "par"], "left")
