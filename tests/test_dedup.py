import itertools
import random
import sys

import pytest
from pyspark import cloudpickle

from quillspark.functions.scoring import ModelScorer, RuleScorer
from quillspark.operators import cascade, dedup, lexicon, report, segment
from quillspark.plans.extraction import extract, reevaluate, with_own_entries

MENTION = "doc_id long, type string, name string, cand_no int, sec int, par int, text string, annotated string, citations struct<m0:array<string>,m1:array<string>,m1b:array<string>,m2:array<string>,m2b:array<string>>"


def _row(i, name, text, par=0, marks=(), doc=1):
    return (doc, "dataset", name, i, 0, par, text, f"{name or 'it'} {text}", ([], list(marks), [], [], []))


def test_average_linkage_equals_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 7)
        scores = {p: rng.choice([0.0, 0.2, 0.45, 0.55, 0.8, 1.0]) for p in itertools.combinations(range(n), 2)}
        clusters = [{i} for i in range(n)]
        while len(clusters) > 1:
            mean = lambda a, b: sum(1 - scores[min(i, j), max(i, j)] for i in a for j in b) / (len(a) * len(b))
            d, a, b = min(((mean(a, b), x, y) for (x, a), (y, b) in itertools.combinations(enumerate(clusters), 2)))
            if d >= 0.5:
                break
            clusters[a] |= clusters.pop(b)
        labels = dedup.average_linkage(n, scores)
        assert sorted(map(sorted, clusters)) == sorted(sorted(i for i in range(n) if labels[i] == k) for k in set(labels))


def test_closest_citation_rules(spark):
    rows = [
        _row(0, "Alpha", "Alpha [1] and Beta [2]", marks=["[1]", "[2]"]), _row(1, "Beta", "Alpha [1] and Beta [2]", marks=["[1]", "[2]"]),
        _row(2, "Gamma", "Gamma with Beta [3]", marks=["[3]"]), _row(3, "Delta", "no name here [4]", marks=["[4]"]), _row(4, "Zeta", "Zeta", marks=[]),
    ]
    got = {r.name: r.citation for r in dedup.closest_citation(spark.createDataFrame(rows, MENTION)).collect()}
    assert got == {"Alpha": "[1]", "Beta": "[2]"}


def test_citations_and_acronyms_merge(spark):
    rows = [_row(0, "Big Corpus", "Big Corpus [1]", marks=["[1]"]), _row(1, "BC", "BC is good"), _row(2, "BC", "BC again"), _row(3, "Large Set", "Large Set [1]", marks=["[1]"]), _row(4, None, "it"), _row(5, "Other", "Other")]
    df = spark.createDataFrame(rows, MENTION).selectExpr("*", "true AS valid", "false AS skipped")
    got = {r.cand_no: (r.label, r.cluster) for r in dedup.deduplicate(df).collect()}
    assert got == {0: ("Big Corpus", "name_cluster_0"), 1: ("BC", "name_cluster_0"), 2: ("BC", "name_cluster_0"), 3: ("Large Set", "name_cluster_0"), 4: ("Unnamed_0", "Unnamed"), 5: ("Other", "name_cluster_5")}
    plain = {r.cand_no: r.cluster for r in dedup.without_dedup(df).collect()}
    assert plain[1] == plain[2] == "name_cluster_1" and plain[0] == "name_cluster_0"


def test_unnamed_mentions_join_similar_ones(spark):
    rows = [_row(0, "A", "cats"), _row(1, None, "cats"), _row(2, None, "dogs"), _row(3, None, "dogs"), _row(4, "B", "dogs", par=1), _row(5, None, "fish", par=2)]
    df = spark.createDataFrame(rows, MENTION)
    same = lambda a, b: float(a.split()[-1] == b.split()[-1])
    assert {r.cand_no: r.label for r in dedup.attach_unnamed(df, same).collect()} == {0: "A", 1: "A", 2: "B", 3: "B", 4: "B", 5: "Unnamed_0"}


def test_scores_group_names(spark):
    names = spark.createDataFrame([(1, "t", n, i, 1) for i, n in enumerate("abcd")], "doc_id long, type string, name string, first int, n long")
    pairs = dedup.name_pairs(names)
    scored = pairs.selectExpr("*", "CASE WHEN name_a = 'a' AND name_b = 'c' THEN 0.9D ELSE 0.1D END AS corefer", "0.0D AS parent", "0.0D AS child")
    got = {r.name: r.grp for r in dedup.group_names(names, dedup.mean_pair_scores(scored)).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 3}


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


class Echo:

    def classify(self, prompts):
        return [0.9 if "MIT" in p else 0.1 for p in prompts]

    def generate(self, prompts):
        return ["MIT License" if "name" in p else "N/A" for p in prompts]


@pytest.mark.parametrize("make", [RuleScorer, lambda: ModelScorer(Echo)])
def test_extraction_and_reports(spark, make):
    texts = [(1, "Introduction\nReleased under the MIT License, version 2.0. It is used here.\nThe data set is small."), (2, "nothing"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lexicon.keyword_rows(spark).unionByName(spark.createDataFrame([(0, "MIT License", "gaz_dataset")], lexicon.LEXICON))
    out = extract(segment.sentences_of_texts(docs), rows, make(), filter_paragraphs=True)
    mentions = out["mentions"].collect()
    assert {(r.phrase, r.valid) for r in mentions} == {("MIT License", True), ("data", False), ("data set", False)}
    assert all(r.name is None and r.ownership is None for r in mentions if not r.valid)
    artifact = report.artifacts(out["clusters"]).collect()
    assert [(r.label, r.mentions_count, r.cluster) for r in artifact] == [("MIT License", 1, "name_cluster_0")]
    again = reevaluate(out["mentions"], 0.5, 0.5, 0.5)
    assert again["artifacts"].count() == 1 and reevaluate(out["mentions"], 0.99)["artifacts"].count() == 0
    assert again["mentions"].head().annotated.count("<m>") == 1


def test_own_entries_come_from_fast_answers(spark):
    docs = spark.createDataFrame([(1, "We use Goal here."), (2, "nothing")], "doc_id long, text string")
    rows = spark.createDataFrame([(0, "Goal", "gaz_dataset"), (1, "use", "software")], lexicon.LEXICON)
    none = spark.createDataFrame([], "phrase string, types array<string>")
    words = spark.createDataFrame([("use",)], "phrase string")
    own = with_own_entries(segment.sentences_of_texts(docs), rows, RuleScorer(), none, words.limit(0), words)
    assert [tuple(r) for r in own.select("doc_id", "phrase", "kind").collect()] == [(1, "Goal", "gaz_dataset")]


def test_thresholds():
    from quillspark.functions.text import normalize_threshold

    assert normalize_threshold(0.6, 2) == 0.6 and normalize_threshold(0.6, 3) == pytest.approx(0.4)
    assert cascade.TEXT_ANSWERS[0] == "name"
