import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm.toxicity import Folder, Lexicon, fold, held_out, learn, score_documents, without_toxic

SF = "/root/testdata/sf0.1"


def test_folding():
    table = Folder()
    assert fold("M0R0N, іdiоt! $tup1d", table) == " moron idiot stupid "
    assert fold("Ünder 5ÀLES wow!", table) == " under sales wow "
    assert fold(None, table) == fold(" \n", table) == "  "


def test_matches_exceptions_and_length():
    lexicon = Lexicon({" clown ": 4.0, " idio": 3.0, " idiot ": 5.0})
    assert lexicon.strength("a cl0wn")[1] == 1 and lexicon.strength("clowns")[1] == 0
    assert lexicon.strength("the clown fish swims")[1] == 0 and lexicon.strength("the clown fish and the clown")[1] == 1
    assert lexicon.strength("idiot") == (5.0, 1) and lexicon.strength("idiotic")[1] == 1
    assert lexicon.strength("clown " + "word " * 99)[0] < lexicon.strength("clown word")[0]
    assert Lexicon({}).strength("clown") == (0.0, 0) and lexicon.strength(None) == (0.0, 0)


def naive(lexicon, text):
    """Every place against every entry, and every match against every exception."""
    folded = fold(text, lexicon.table)
    spans = []
    for phrase in {fold(p, lexicon.table) for p in lexicon.exceptions} - {"  "}:
        spans += [range(i, i + len(phrase) - 1) for i in range(len(folded)) if folded.startswith(phrase, i)]
    best = {}
    for i in range(len(folded)):
        found = [w for entry, w in lexicon.weights.items() if folded.startswith(entry, i)]
        if found and not any(i in s for s in spans):
            best[i] = max(found)
    return sum(best[i] for i in sorted(best)) / max(1, len(folded.split())) ** lexicon.length_power, len(best)


WORDS = st.lists(st.sampled_from(["clown", "cl0wn", "fish", "idiot", "1diotic", "idio", "trash", "can", "trash can", "bin", "ok", "prооf", "proof", "idiot proof", "!", "\n"]), max_size=40).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_matches_equal_a_naive_scan(text):
    lexicon = Lexicon({" clown ": 4.0, " idio": 3.0, " idiot ": 5.0, " trash ": 1.5, " trash can ": 9.0, " fish ": 0.5})
    assert lexicon.strength(text) == pytest.approx(naive(lexicon, text))


def test_many_exceptions_take_linear_time():
    lexicon = Lexicon({" clown ": 4.0, " idiot ": 5.0})
    assert lexicon.strength("clown fish idiot " * 60_000)[1] == 60_000


def test_an_exception_that_is_an_entry_is_harmless():
    assert Lexicon({" trash can ": 9.0, " trash ": 2.0}).strength("a trash can and trash") == (2.0 / 5**0.5, 1)


def test_held_out_rule(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, learn(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, lexicon = trained
    got = {r.doc_id: r for r in score_documents(docs, lexicon).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    rows = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    hit = sum(p == t == 1 for p, t in rows)
    assert hit >= 0.9 * sum(t for _, t in rows) and hit >= 0.9 * sum(p for p, _ in rows)


def test_labels_of_held_out_rows_teach_nothing(spark):
    texts = [(i, "plain words here" if i % 2 else "awful words here") for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 == 0 else 0) for i in range(200)], "doc_id long, toxic int")
    assert learn(docs, labels).weights == {}


def test_odd_rows(spark, trained):
    lexicon = trained[2]
    rows = [(1, None), (2, ""), (None, "you idiot moron scum"), (3, "you idiot moron scum"), (3, "you idiot moron scum"), (4, "fine words " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS predicted")
    got = sorted(((r.doc_id, r.predicted) for r in score_documents(docs, lexicon).collect()), key=repr)
    assert got == sorted([(1, 0), (2, 0), (None, 1), (3, 1), (3, 1), (4, 0)], key=repr)
    kept = without_toxic(docs, lexicon)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert score_documents(docs.limit(0), lexicon).collect() == []
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert learn(docs, none).weights == {}
