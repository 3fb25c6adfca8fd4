import hashlib

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillspark.llm import bpe  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.parse_ranks(open(PATH, "rb").read())
PLAIN = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE = bpe.TreeEncoder(RANKS, PATTERN)

ODD = st.text(st.sampled_from(list("abté ñ\n\t'sre12.,!-  \x1c\x85中文字ก้😀")), max_size=400)


def merge_loop(data):
    """The pair of the lowest rank merges first, the leftmost of equals, until no pair has a rank."""
    parts = [bytes([b]) for b in data]
    while True:
        best = min(((RANKS[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in RANKS), default=None)
        if best is None:
            return [RANKS[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def plain_encode(text):
    return [i for match in regex.findall(PATTERN, text) for i in merge_loop(match.encode())]


@settings(max_examples=200, deadline=None)
@given(st.one_of(ODD, st.text(max_size=300), st.lists(st.sampled_from(["ention", "über", " ", "\n", "x9", "中文", "don't", "  "]), max_size=90).map("".join)))
def test_same_ids_as_a_plain_merge_loop(text):
    ids = TREE.encode(text)
    assert ids == plain_encode(text) and TREE.decode(ids) == text.encode()


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 8)
    monkeypatch.setattr(bpe, "LEAF_BYTES", 4)
    monkeypatch.setattr(bpe, "LEAF_IDS", 4)
    monkeypatch.setattr(bpe, "WINDOW", 2)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_same_ids_as_the_library_with_small_leaves(text):
    old = bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS, bpe.WINDOW
    bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS, bpe.WINDOW = 8, 4, 4, 2
    try:
        ids = TREE.encode(text)
        assert ids == PLAIN.encode_ordinary(text)
        assert TREE.decode(ids) == text.encode()
    finally:
        bpe.LEAF_CHARS, bpe.LEAF_BYTES, bpe.LEAF_IDS, bpe.WINDOW = old


@pytest.mark.parametrize("text", ["", "a" * 5000, " " * 3000, "word " * 2000, "中文" * 3000, "x" * 3000 + " y" + "z" * 3000, "ab" * 700 + "'re " + "\n" * 900 + "q", "<|endoftext|> " * 300])
def test_long_runs(text):
    assert TREE.encode(text) == PLAIN.encode_ordinary(text)


def test_pieces_of_bytes_join(small_leaves):
    for data in (b"internationalization" * 9, "übermäßig".encode() * 11, bytes(range(256)) * 2):
        assert TREE.piece(data) == PLAIN._encode_single_piece(data)


def test_query_on_whole_texts(spark):
    docs = spark.createDataFrame([(1, "Hello  world\n'tis 12"), (2, None), (3, ""), (None, "x"), (1, "Hello  world\n'tis 12"), (4, "tok en " * 3000)], "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "1 AS ids", "2 AS decoded")
    ranks = bpe.read_ranks(spark, PATH)
    got = bpe.digests(bpe.decode_documents(bpe.encode_documents(docs, ranks, PATTERN), ranks, PATTERN)).collect()

    def row(doc, text):
        ids = PLAIN.encode_ordinary(text)
        return doc, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    want = [row(d.doc_id, d.text or "") for d in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    both = bpe.round_trip(docs.withColumn("place", F.lit(7)), ranks, PATTERN, keep=("place",), with_ids=True)
    assert both.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "place"]
    assert sorted(map(repr, (tuple(r)[:4] for r in both.collect()))) == sorted(map(repr, want))
    assert all(r.place == 7 and hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 for r in both.collect())


def test_empty_table(spark):
    ranks = bpe.read_ranks(spark, PATH)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, ranks, PATTERN).collect() == []
