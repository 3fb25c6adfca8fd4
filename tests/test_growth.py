"""Steps whose time must not grow faster than their input: what they run, and the same results."""

import random

from pyspark.sql import functions as F

from quillspark import catalog
from quillspark.catalog_sql import ARTIFACT_LEXICON
from quillspark.operators import dedup, lexicon, match, segment
from quillspark.plans import extraction

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_groups_merge_without_a_call_for_each_document(spark):
    rng = random.Random(4)
    groups = [(d, t, f"n{g}", g, 1, g) for d in range(40) for t in ("dataset", "software") for g in range(9)]
    edges = [(d, "dataset", *sorted(rng.sample(range(9), 2))) for d in range(30) for _ in range(rng.randrange(6))]
    g = spark.createDataFrame(groups, "doc_id long, type string, name string, first int, n long, grp int")
    merged = dedup.merge_groups(g, spark.createDataFrame(edges, "doc_id long, type string, a int, b int"))
    want = {(d, t, name): grp for d, t, name, _, _, grp in groups}
    changed = True
    while changed:
        changed = False
        for d, t, a, b in edges:
            least = min(want[d, t, f"n{a}"], want[d, t, f"n{b}"])
            for x in (a, b):
                changed |= want[d, t, f"n{x}"] != least
                want[d, t, f"n{x}"] = least
    assert merged.schema == g.schema and {(r.doc_id, r.type, r.name): r.grp for r in merged.collect()} == want
    assert merged.count() == len(groups) and "CoGroup" not in _plan(merged)


TEXTS = [
    "A license.\nNone here.\nThe Apache\tLicense", "see e.g.\tMIT License, vs.  CC BY-NC", "ΑΣ. ΑΣ\nΑΣΑ", "İx VERSION. C++ too", "Apache\nLicense", "GNU General\nGNU General Public License v. 2",
    "", None, "licenses", "al.  x", "al. x\nalx", "a␟b␞c", "C+ +", "one e.g.\t two",
]


def test_lines_without_a_phrase_are_not_split(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    own = [(i, p, "dataset") for i, p in enumerate(["al. x", "ΑΣ.", "ασα", "a b", "e.g. two", "c++", "++", "İx", "e.g. t"])]
    for rows in (ARTIFACT_LEXICON, own, own[:1], own[4:5]):
        lex = spark.createDataFrame(rows, lexicon.LEXICON)
        whole = segment.sentences_of_texts(docs, offsets=True)
        part = segment.sentences_of_texts(docs, offsets=True, where=match.may_match(lex))
        assert part.count() < whole.count()
        a, b = (sorted(map(repr, extraction.candidates(s, lex).collect())) for s in (whole, part))
        assert a == b and a
    many = spark.createDataFrame([(i, f"p{i}", "dataset") for i in range(match.FEW_ROWS + 1)], lexicon.LEXICON)
    assert match.may_match(many) is None and match.may_match(lex.limit(0))(F.lit("x")) is not None


def test_mentions_search_lines_before_they_split_them(spark):
    assert "exists(array(lower(" in _plan(catalog._mentions(spark, SF))


def test_sentences_of_a_word_are_those_of_lines_with_it(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    word = lambda text: text.contains("License")
    whole, part = segment.sentences_of_texts(docs), segment.sentences_of_texts(docs, where=word)
    assert part.count() < whole.count()
    assert sorted(map(repr, part.where(word(F.col("text"))).collect())) == sorted(map(repr, whole.where(word(F.col("text"))).collect()))


def test_queries_on_clusters_call_python_for_no_document(spark, monkeypatch):
    saved = []
    save = dedup.Workspace.save
    monkeypatch.setattr(dedup.Workspace, "save", lambda self, df: saved.append(_plan(df)) or save(self, df))
    for name in ("simple_lists", "license_shares", "artifact_report"):
        saved.append(_plan(catalog.QUERIES[name](spark, SF)))
        assert len(saved) > 4 and not any("InPandas" in p for p in saved)
