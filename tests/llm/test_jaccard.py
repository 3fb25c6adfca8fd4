import random

import numpy as np
import pytest

from quillspark.llm import ngram_jaccard
from quillspark.llm.ngram_jaccard import Levels, can_link, fragment_keys, fragment_marks, jaccard_components, linked
from quillspark.llm.shingles import Shingler

from .brute import jaccard, jaccard_links


def corpus(seed=1, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=3))
    texts = {}
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = texts[rng.choice(list(texts))].split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                words[rng.randrange(len(words))] = word()
            texts[i] = " ".join(words)
        else:
            texts[i] = " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 150, 700])))
    return texts


@pytest.mark.parametrize(("width", "percent", "bucket"), [(3, 90, 16), (5, 80, 16), (2, 50, 16), (3, 80, 1), (3, 80, 4)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, bucket):
    monkeypatch.setattr(ngram_jaccard, "BUCKET", bucket)
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = jaccard_components(docs, width, percent, block_rows=7, block_items=2000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == jaccard(texts, width, percent)
    assert {r.doc_id: r.n_links for r in found} == jaccard_links(texts, width, percent)


def test_a_large_group_spans_blocks(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(base[: i % 60] + [f"x{i}"] + base[i % 60 + 1 :]) for i in range(120)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, 80, block_rows=16).collect()}
    assert got == jaccard(texts, 3, 80)


@pytest.mark.parametrize("percent", [80, 90])
def test_common_n_grams_join_nothing(spark, monkeypatch, percent):
    """Every text holds the same three n-grams; without the rule on large keys they would be one group of candidates."""
    rng, counts = random.Random(7), []
    common = "all rights reserved everywhere always"

    def text(n):
        words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(n)]
        at = rng.randrange(n)
        return " ".join([*words[:at], common, *words[at:]])

    texts = {i: text(rng.choice([25, 40, 60])) for i in range(500)}
    texts |= {500 + i: texts[i] + (" more" if i % 2 else "") for i in range(20)}
    plain = ngram_jaccard.connected_components

    def counted(edges, *more):
        counts.append(edges.count())
        return plain(edges, *more)

    monkeypatch.setattr(ngram_jaccard, "connected_components", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, 3, percent).collect()}
    assert got == jaccard(texts, 3, percent)
    assert counts[0] <= 40


def test_odd_rows(spark):
    rows = [(1, "A b"), (2, "a  B\n"), (3, None), (4, ""), (5, " \t\n"), (None, "a b"), (1, "A b"), (6, "a b c d"), (7, "q" * 5), (8, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS u", "3 AS component_id")
    got = sorted(map(tuple, jaccard_components(docs, 3, 90).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    want = [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (None, 1, None), (6, 2, 6), (7, 1, 7), (8, 1, 8)]
    assert got == sorted(want, key=repr)
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    rng, levels = np.random.default_rng(3), Levels(percent)
    for n in (5, 12, 40, 200, 1500):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, int(n * (100 - percent) / 100)) + 1)
            b = np.union1d(a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64))
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= percent * (len(a) + len(b) - shared):
                parts = [{(level.no, k): (set(keys.tolist()), need) for level in levels.of(len(x)) for k, (keys, need) in enumerate(fragment_keys(x, level))} for x in (a, b)]
                enough = [len(parts[0][p][0] & parts[1][p][0]) >= max(parts[0][p][1], parts[1][p][1]) for p in parts[0].keys() & parts[1].keys()]
                assert any(enough) or np.array_equal(a, b)
                if any(enough):
                    assert can_link(len(a), fragment_marks(a, levels.of(len(a))), len(b), fragment_marks(b, levels.of(len(b))), levels)


def test_partial_overlaps_sum_over_fragments():
    shingles = Shingler(2)
    sets = [shingles(t) for t in ("a b c d e f", "a b c d e g", "z y x w", "a b c d e f")]
    narrow, wide = linked(sets, sets, 60, columns=1), linked(sets, sets, 60)
    assert (narrow == wide).all() and narrow[0, 1] and narrow[0, 3] and not narrow[0, 2]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 10, 1])
def test_the_bitmap_of_members_loses_no_text(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_jaccard, "ID_BITS", bits)
    ids = [*range(-400, 400), 2**63 - 1, -(2**63)]
    docs = spark.createDataFrame([*((i, str(i)) for i in ids), (5, None), (None, "a")], "doc_id long, text string")
    members = {i for i in ids if i % 17 == 0} | {-(2**63)}
    found = ngram_jaccard._marked(docs, spark.createDataFrame([(i,) for i in sorted(members)], "doc_id long")).collect()
    assert {r.doc_id for r in found} >= members and len(found) <= len(ids) + 2
    if bits == 1 << 27:
        assert len(found) < 2 * len(members)
    empty = spark.createDataFrame([], "doc_id long")
    assert ngram_jaccard._marked(docs, empty).count() == 0
