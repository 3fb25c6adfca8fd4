"""The question cascade: validity first, everything else for valid candidates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fixed import DATA_PHRASES, SOFTWARE_PHRASES
from quillspark.functions.scoring import Scorer
from quillspark.functions.text import answer_types, strip
from quillspark.plans.storage import Workspace

TEXT_ANSWERS = ("name", "license", "version", "url")


def is_yes(p_yes: Column, threshold: float = 0.0) -> Column:
    """Yes is at least as likely as No, and at least as likely as the threshold."""
    return (p_yes >= 1 - p_yes) & (p_yes >= threshold)


def without_keyword_names(name: Column, keywords: tuple[str, ...] = DATA_PHRASES + SOFTWARE_PHRASES) -> Column:
    """Null for a name that is itself a keyword."""
    return F.when(~F.lower(strip(name)).isin(*keywords), name)


def relevant_paragraphs(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """Adds ``skipped``: the paragraph's answer to the list question does not name the candidate's type.

    Takes answers (doc_id, sec, par, answer) for paragraphs with candidates; N/A names no type.
    """
    named = answers.select("doc_id", "sec", "par", F.explode(answer_types("answer")).alias("type")).distinct()
    kept = named.withColumn("kept_", F.lit(True))
    joined = candidates.join(kept, ["doc_id", "sec", "par", "type"], "left")
    return joined.withColumn("skipped", F.col("kept_").isNull()).drop("kept_")


def paragraph_counts(candidates: DataFrame) -> DataFrame:
    """Candidates of each paragraph and kind."""
    return candidates.groupBy("doc_id", "sec", "par", "kind").agg(F.count(F.lit(1)).alias("n"))


def run_cascade(candidates: DataFrame, scorer: Scorer, thresholds: dict[str, float] | None = None, blank_keywords: bool = True) -> DataFrame:
    """Adds ``artifact_yes, valid, name, license, version, url, ownership_yes, ownership, reuse_yes, reuse``.

    Rejected candidates have only the first two; skipped ones (a true ``skipped`` column) have nulls throughout. A
    scorer that is expensive runs its first question on a written table, so that no plan asks it twice.
    """
    t = {"artifact": 0.0, "ownership": 0.0, "reuse": 0.0} | (thresholds or {})
    skipped = F.col("skipped") if "skipped" in candidates.columns else F.lit(False)
    asked = candidates.withColumn("skipped", skipped)
    first = F.when(~F.col("skipped"), scorer.yes("artifact"))
    if scorer.expensive:
        work = Workspace(candidates.sparkSession, "cascade")
        ready = asked.where(~F.col("skipped")).withColumn("artifact_yes", scorer.yes("artifact"))
        scored = work.save(ready.unionByName(asked.where("skipped").withColumn("artifact_yes", F.lit(None).cast("double"))))
    else:
        scored = asked.withColumn("artifact_yes", first)
    scored = scored.withColumn("valid", is_yes(F.col("artifact_yes"), t["artifact"]))
    if not scorer.expensive:
        return scored.select("*", *(F.when(F.col("valid"), x).alias(n) for n, x in _answers(scorer, t, blank_keywords)))
    valid = scored.where("valid").select("*", *(x.alias(n) for n, x in _answers(scorer, t, blank_keywords)))
    nulls = [F.lit(None).cast(valid.schema[n].dataType).alias(n) for n, _ in _answers(scorer, t, blank_keywords)]
    return valid.unionByName(scored.where("NOT coalesce(valid, false)").select("*", *nulls))


def _answers(scorer: Scorer, t: dict[str, float], blank_keywords: bool) -> list[tuple[str, Column]]:
    out = []
    for n in TEXT_ANSWERS:
        x = scorer.answer(n)
        out.append((n, without_keyword_names(x) if n == "name" and blank_keywords else x))
    for n in ("ownership", "reuse"):
        p = scorer.yes(n)
        out += [(f"{n}_yes", p), (n, F.when(is_yes(p, t[n]), "Yes").otherwise("No"))]
    return out


def apply_thresholds(mentions: DataFrame, artifact: float = 0.8, ownership: float = 0.8, reuse: float = 0.8) -> DataFrame:
    """Mentions at or above the artifact threshold, with Yes or No by the other two."""
    kept = mentions.where(F.col("artifact_yes") >= artifact)
    return kept.withColumn("ownership", F.when(F.col("ownership_yes") >= ownership, "Yes").otherwise("No")).withColumn("reuse", F.when(F.col("reuse_yes") >= reuse, "Yes").otherwise("No"))
