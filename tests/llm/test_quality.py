import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import quality_rules as q

from .brute import WORD, quality, repeated_chars

TEXTS = st.lists(st.sampled_from(["a", "bb", "é#", "\n", " ", "\t", "<x>", "\x1c", " z", "a b c d e f g h "]), max_size=120).map(" ".join)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_equal_brute_force(text):
    m = q.measure(text, q.Limits())
    assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == quality(text)[:5]
    words = WORD.findall(text)
    for n in (5, 7, 10):
        share = m.get(f"dup_{n}", 0.0)
        assert abs(share * max(1, m["word_chars"]) - repeated_chars(words, n)) < 1e-6


def top_chars(words, n):
    """The largest number of characters inside one of the most frequent n-grams; 0 if none repeats."""
    places = {}
    for i in range(len(words) - n + 1):
        places.setdefault(tuple(words[i : i + n]), []).append(i)
    most = max(map(len, places.values()), default=0)
    if most < 2:
        return 0
    return max(sum(len(words[j]) for j in {i + k for i in at for k in range(n)}) for at in places.values() if len(at) == most)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_most_frequent_of_ties_equals_brute_force(text):
    m = q.measure(text, q.Limits())
    words = WORD.findall(text)
    for n in (2, 3, 4):
        assert abs(m.get(f"top_{n}", 0.0) * max(1, m["word_chars"]) - top_chars(words, n)) < 1e-6


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_lines_and_verdict_equal_brute_force(text):
    limits = q.Limits()
    m = q.measure(text, limits)
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    chars = sum(map(len, words))
    again = sum(len("".join(WORD.findall(x))) for i, x in enumerate(lines) if x in lines[:i])
    assert abs(m["line_char_share"] * max(1, chars) - again) < 1e-6
    failed = ["line_char_share"] * (again > limits.line_chars * chars)
    failed += [f"top_{n}" for n, most in limits.top.items() if top_chars(words, n) > most * chars]
    failed += [f"dup_{n}" for n, most in limits.duplicated.items() if repeated_chars(words, n) > most * chars]
    assert sorted(m["failed_rules"]) == sorted(failed)


def test_lines_count_characters_of_words():
    """40 letters of two bytes, twice, beside 148 others: 0.175 by characters, under the limit; bytes and spaces would be over it."""
    text = "é" * 40 + "\n" + " \t é" .replace("é", "é" * 40).strip() + "\n" + " ".join(f"w{i:03}" for i in range(37))
    m = q.measure(text, q.Limits())
    assert m["line_char_share"] == 40 / 228 and "line_char_share" not in m["failed_rules"]


def test_widest_of_ties_decides():
    rest = " ".join(f"w{i}" for i in range(60))
    pairs = ["a b", "extraordinarily longwinded", "c d"]
    for turn in range(3):
        found = " ".join(f"{p} x{turn}{k}{i}" for k in range(3) for i, p in enumerate(pairs[turn:] + pairs[:turn]))
        assert q.measure(f"{found} {rest}", q.Limits())["failed_rules"] == ["top_2"]


def test_colliding_hashes_do_not_count(monkeypatch):
    ids = np.array([random.Random(1).randrange(9) for _ in range(200)])
    want = q.window_groups(ids, 3)
    monkeypatch.setattr(q, "FACTOR", 0)  # every window ending in one word collides
    got = q.window_groups(ids, 3)
    assert ((want[:, None] == want) == (got[:, None] == got)).all()


def test_rows(spark):
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, clean), (3, clean), (None, clean), (4, "one two three four five six seven eight " * 9), (5, clean + "\n" + "x " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS n_words", "8 AS kept")
    got = {(r.doc_id): r for r in q.quality_rules(docs).collect()}
    assert [got[k].kept for k in (1, 2, 3, None, 4, 5)] == [False, False, True, True, False, False]
    assert got[1].base_failed and got[2].base_failed and got[4].base_failed
    for r in rows:
        assert (got[r[0]].n_words, got[r[0]].word_chars, got[r[0]].n_symbols, got[r[0]].n_dup_lines, got[r[0]].n_repeat_words, got[r[0]].base_failed) == quality(r[1])
    assert q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).collect() == []
