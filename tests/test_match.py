import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillspark.operators import lexicon, match, segment
from quillspark.plans.extraction import candidates, extract_fast

EXAMPLE = [
    "Work on bread and its makers never stops.",
    "Last year three datasets (all of rye) were made, with the goal of comparing models (say methods, moods) and things to hold (say datasets, software) (Roe et al., 2021).",
]
WORDS = st.lists(st.sampled_from(["data", "Data", "set", "base", "C++", "c++x", ".net", "a.net", "été", "-", ",", "a b a", "ab", "the", "++"]), max_size=14).map(" ".join)
PHRASES = ["data", "Data", "data set", "C++", ".net", "été", "a b a", "the", "set - base", "a", "++"]


def _brute(sentence, phrase):
    low, p = sentence.lower(), phrase.lower()
    return [m.span() for m in re.finditer(rf"\b{re.escape(p)}\b", low)]


def test_matches_equal_a_loop_of_regular_expressions(spark):
    found = []

    @settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
    @given(WORDS)
    def collect(text):
        found.append(text)

    collect()
    sentences = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string").selectExpr("doc_id", "0 AS sec", "0 AS par", "0 AS sent", "text")
    rows = spark.createDataFrame([(i, p, "software") for i, p in enumerate(PHRASES)], lexicon.LEXICON)
    got = sorted((r.doc_id, r.phrase, r.start, r.end) for r in match.match_lexicon(sentences, rows).collect())
    want = sorted((i, p, s, e) for i, t in enumerate(found) for p in PHRASES for s, e in _brute(t, p))
    assert got == want and want


def test_shuffled_lexicon_gives_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(1, EXAMPLE[1]), (2, None), (3, "")], "doc_id long, text string")
    rows, s = lexicon.keyword_rows(spark), segment.sentences_of_texts(docs)
    small = sorted(map(tuple, match.match_lexicon(s, rows).select("doc_id", "phrase", "start").collect()))
    monkeypatch.setattr(match, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, match.match_lexicon(s, rows).select("doc_id", "phrase", "start").collect())) == small and small


def test_example_with_gazetteer(spark):
    rows = lexicon.keyword_rows(spark).unionByName(spark.createDataFrame([(0, "Goal", "gaz_dataset"), (1, "BASE", "gaz_method")], lexicon.LEXICON))
    lists = spark.createDataFrame([("x", [EXAMPLE])], "doc_id string, text_list array<array<string>>")
    got = candidates(segment.sentences_of_lists(lists), rows).orderBy("cand_no").collect()
    assert [(r.mention_id, r.kind, r.phrase, r.type) for r in got] == [
        ("C0", "dataset", "datasets", "dataset"), ("C1", "gaz_dataset", "Goal", "dataset"), ("C2", "software", "models", "software"), ("C3", "software", "methods", "software"),
        ("C4", "dataset", "datasets", "dataset"), ("C5", "software", "software", "software"),
    ]
    assert got[1].annotated[got[1].start :].startswith("<m>goal</m>") and got[0].snippet_start == len(EXAMPLE[0]) + 1
    fast = extract_fast(segment.sentences_of_lists(lists), rows).head()
    assert fast.candidates == "[dataset] : datasets | [dataset] : Goal | [software] : models | [software] : methods | [software] : software"


def test_ids_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, EXAMPLE[1]) for i in range(20)], "doc_id long, text string")
    rows = lexicon.keyword_rows(spark)
    a, b = (sorted(map(tuple, match.number_candidates(match.match_lexicon(segment.sentences_of_texts(docs.repartition(n)), rows)).select("doc_id", "mention_id", "phrase").collect())) for n in (1, 7))
    assert a == b


def test_document_lexicon_and_empty_input(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta")], "doc_id long, text string")
    own = spark.createDataFrame([(2, 0, "alpha", "gaz_dataset")], "doc_id long, rank int, phrase string, kind string")
    s = segment.sentences_of_texts(docs)
    assert [r.doc_id for r in match.match_lexicon(s, own).collect()] == [2]
    assert match.match_lexicon(s, own.limit(0)).collect() == [] and match.match_lexicon(s.limit(0), own).collect() == []
