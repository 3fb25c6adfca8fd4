"""Lexicons: gazetteers and keyword lists as rows of (rank, phrase, kind), optionally for one document each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.fixed import DATA_PHRASES, GAZETTEER_TYPE, NOISE_KEYS, SOFTWARE_PHRASES
from quillspark.functions.text import parse_answer, strip

LEXICON = "rank int, phrase string, kind string"


def flatten_datasets(datasets: DataFrame) -> DataFrame:
    """Distinct stripped names and variants."""
    names = datasets.select(F.explode(F.concat(F.array("name"), F.coalesce("variants", F.array().cast("array<string>")))).alias("phrase"))
    return _clean(names)


def flatten_methods(methods: DataFrame) -> DataFrame:
    """Distinct stripped names and full names."""
    return _clean(methods.select(F.explode(F.array("name", "full_name")).alias("phrase")))


def _clean(names: DataFrame) -> DataFrame:
    return names.where("phrase IS NOT NULL AND phrase != ''").select(strip("phrase").alias("phrase")).distinct()


def merge(methods: DataFrame, datasets: DataFrame) -> DataFrame:
    """``phrase, types``: each phrase once, with Method before Dataset."""
    both = methods.select("phrase", F.struct(F.lit(0), F.lit("Method").alias("t")).alias("x")).unionByName(datasets.select("phrase", F.struct(F.lit(1), F.lit("Dataset").alias("t")).alias("x")))
    return both.groupBy("phrase").agg(F.transform(F.array_sort(F.collect_set("x")), lambda x: x["t"]).alias("types"))


def without_noise(gazetteer: DataFrame, noise: tuple[str, ...] = NOISE_KEYS) -> DataFrame:
    return gazetteer.where(~F.col("phrase").isin(*noise))


def from_annotated(snippets: DataFrame) -> DataFrame:
    """``phrase, type`` of valid snippets with <m>..</m>."""
    phrase = F.regexp_extract("Snippet", "<m>(.*)</m>", 1)
    kind = F.lower("Type")
    mapped = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in GAZETTEER_TYPE.items()))
    return snippets.where("Valid = 'Yes'").select(phrase.alias("phrase"), mapped.alias("type")).where("phrase != '' AND type IS NOT NULL").distinct()


def new_entries(entries: DataFrame, base: DataFrame, data_phrases: DataFrame, software_phrases: DataFrame) -> DataFrame:
    """Entries (phrase, type) that neither the base gazetteer (phrase, types) nor the keyword list of their type has."""
    known = base.select("phrase", F.explode("types").alias("type"))
    known = known.unionByName(data_phrases.select("phrase", F.lit("Dataset").alias("type"))).unionByName(software_phrases.select("phrase", F.lit("Method").alias("type")))
    return entries.distinct().join(known, ["phrase", "type"], "left_anti")


def select_external(name: str | None, synthetic: DataFrame, hybrid: DataFrame) -> DataFrame | None:
    """The external gazetteer of a name: none, synthetic or hybrid."""
    known = {None: None, "synthetic": synthetic, "hybrid": hybrid}
    if name not in known:
        raise ValueError(f"unknown gazetteer: {name!r}")
    return known[name]


def from_answers(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """``doc_id, phrase, type``: entries that fast answers give to their own document."""
    found = answers.select("doc_id", F.explode(parse_answer(answer_col)).alias("x"))
    kind = F.when(F.col("x.type") == "software", "Method").when(F.col("x.type") == "dataset", "Dataset")
    return found.select("doc_id", F.col("x.name").alias("phrase"), kind.alias("type")).where("type IS NOT NULL").distinct()


def keyword_rows(spark: SparkSession, data=DATA_PHRASES, software=SOFTWARE_PHRASES) -> DataFrame:
    rows = [(i, p, "dataset") for i, p in enumerate(data)] + [(i, p, "software") for i, p in enumerate(software)]
    return spark.createDataFrame(rows, LEXICON)


def gazetteer_rows(gazetteer: DataFrame, offset: int = 0) -> DataFrame:
    """Lexicon rows of (phrase, types); ranks by phrase after ``offset``. Gazetteers are lists of names: small."""
    typed = gazetteer.select("phrase", F.explode("types").alias("type"))
    rank = F.row_number().over(Window.orderBy("phrase")) - 1 + offset
    ranked = gazetteer.select("phrase", rank.cast("int").alias("rank"))
    kind = F.when(F.col("type") == "Dataset", "gaz_dataset").otherwise("gaz_method")
    return typed.join(ranked, "phrase").select("rank", "phrase", kind.alias("kind"))
