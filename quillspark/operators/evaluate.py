"""Evaluation against gold rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.fixed import MISSING


#: Fields that count where both sides are valid.
FIELDS = ("name", "version", "license", "url", "ownership", "usage")


def _positive(field: str) -> Callable[[Column], Column]:
    """Whether a field's value is a positive one: an answer, or Yes for the yes-or-no questions."""
    return (lambda x: x == "Yes") if field in ("valid", "ownership", "usage") else (lambda x: x != MISSING)


def exact(pred: Column, gold: Column, lower: Callable[[Column], Column] = F.lower) -> Column:
    return lower(pred) == lower(gold)


def lenient(pred: Column, gold: Column, lower: Callable[[Column], Column] = F.lower) -> Column:
    """Either contains the other, whatever the case."""
    return lower(pred).contains(lower(gold)) | lower(gold).contains(lower(pred))


def match_rates(rows: DataFrame, pred: str, gold: str, lower: Callable[[Column], Column] = F.lower) -> DataFrame:
    """``n, exact, lenient``: shares of matching rows, 0 for none."""
    rate = lambda f: F.coalesce(F.round(F.avg(f(F.col(pred), F.col(gold), lower).cast("int")), 6), F.lit(0.0))
    return rows.agg(F.count(F.lit(1)).alias("n"), rate(exact).alias("exact"), rate(lenient).alias("lenient"))


def match_errors(rows: DataFrame, item: str, pred: str, gold: str, lower: Callable[[Column], Column] = F.lower) -> DataFrame:
    """The rows that do not match exactly, as (item, pred, gold)."""
    return rows.where(~exact(F.col(pred), F.col(gold), lower)).select(F.col(item).alias("item"), F.col(pred).alias("pred"), F.col(gold).alias("gold"))


def binary_scores(rows: DataFrame, pred: Column, gold: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of two boolean columns; a division by zero gives 0."""
    flags = rows.select(*(keys or []), pred.alias("p"), gold.alias("g"))
    counts = flags.groupBy(*(keys or [])).agg(F.count_if(F.col("p") & F.col("g")).alias("tp"), F.count_if(F.col("p") & ~F.col("g")).alias("fp"), F.count_if(~F.col("p") & F.col("g")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*(keys or []), "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def derive_offsets(snippet: Column) -> Column:
    """Start and end of what stands between <m> and </m>, and the text without the tags."""
    start, end = F.instr(snippet, "<m>") - 1, F.instr(snippet, "</m>") - 4
    return F.struct(start.alias("start"), end.alias("end"), F.regexp_replace(snippet, "</?m>", "").alias("text"))


def evaluate(rows: DataFrame) -> DataFrame:
    """One row for each field: P, R and F1, and match rates. Takes pred_* and gold_* columns of valid, name, version,
    license, url, ownership and usage; fields but valid count where both sides are valid, with an answer as positive."""
    both = rows.where("pred_valid = 'Yes' AND gold_valid = 'Yes'")
    out = binary_scores(rows, F.col("pred_valid") == "Yes", F.col("gold_valid") == "Yes").select(F.lit("valid").alias("field"), "*", F.lit(None).cast("double").alias("exact"), F.lit(None).cast("double").alias("lenient"))
    for field in FIELDS:
        p, g = F.col(f"pred_{field}"), F.col(f"gold_{field}")
        positive = _positive(field)
        scores = binary_scores(both, positive(p), positive(g))
        rates = match_rates(both.where(positive(p) & positive(g)), f"pred_{field}", f"gold_{field}").drop("n")
        out = out.unionByName(scores.crossJoin(rates).select(F.lit(field).alias("field"), "*"))  # one row each
    return out


def errors(rows: DataFrame, item: str = "item") -> DataFrame:
    """``item, field, kind, gold, pred``: every answer that counts against a score of ``evaluate``, in one scan.

    Kind ``binary`` is a wrong decision (validity, whether a field has an answer, ownership, usage); ``exact`` and
    ``lenient`` are answers on both sides that do not match so. A comparison with a null is no error.
    """
    both = (F.col("pred_valid") == "Yes") & (F.col("gold_valid") == "Yes")
    found = []
    for field in ("valid", *FIELDS):
        p, g = F.col(f"pred_{field}"), F.col(f"gold_{field}")
        decision = field in ("valid", "ownership", "usage")
        positive = _positive(field)
        kinds = [("binary", positive(p) != positive(g))]
        if not decision:
            kinds += [(kind, positive(p) & positive(g) & ~match(p, g)) for kind, match in (("exact", exact), ("lenient", lenient))]
        for kind, wrong in kinds:
            counts = wrong if field == "valid" else wrong & both
            found.append(F.when(counts, F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), g.alias("gold"), p.alias("pred"))))
    return rows.select(F.col(item).alias("item"), F.explode(F.array_compact(F.array(*found))).alias("e")).select("item", "e.*")


def metrics_json(scores: DataFrame) -> DataFrame:
    """All scores as one JSON text."""
    return scores.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", F.struct("tp", "fp", "fn", "precision", "recall", "f1", "exact", "lenient")))))).alias("metrics"))
