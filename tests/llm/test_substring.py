import random

from quillspark.llm.substring_dedup import Words, pieces_of, removed_name, substring_dedup, units_of

from . import brute


def _words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 7))) for _ in range(n))


def _collected(df):
    return {r.doc_id: (r.text, [(x.start, x.end) for x in r[df.columns[-1]]]) for r in df.collect()}


def test_passages_inside_lines_go(spark):
    """55 words planted in the middle of lines, with other words, signs and case around them."""
    rows = []
    for n in range(40):
        passage = _words(1000 + n, 55)
        rows.append((2 * n, f"{_words(n, 30)} {passage} {_words(n + 200, 9)}\n{_words(n + 300, 30)}"))
        rows.append((2 * n + 1, f"{_words(n + 400, 17)} {passage.upper()}, {_words(n + 500, 21)}"))
    rows += [(1000 + n, _words(n + 600, 80)) for n in range(40)]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = _collected(got)
    assert found == brute.substring_dedup(rows)
    assert all(found[i][0] == t for i, t in rows if i >= 1000 or i % 2 == 0)
    cut = [i for i, t in rows if i < 1000 and i % 2 and found[i][0] != t]
    assert len(cut) >= 38
    keepers = {r.doc_id: [x.keeper for x in r.removed_] for r in got.collect()}
    assert all(keepers[i] == [i - 1] for i in cut)


def test_random_texts_equal_brute_force(spark):
    r = random.Random(5)
    parts = [_words(n, r.randrange(1, 40)) for n in range(12)]
    rows = [(i, "".join(r.choice(parts) + r.choice([" ", "\n", " \n\n", "\t", ". "]) for _ in range(r.randrange(0, 9)))) for i in range(150)]
    assert _collected(substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.substring_dedup(rows)


def test_odd_rows(spark):
    unit, other, long = _words(1, 30), _words(2, 30), _words(3, 60_000)
    rows = [(5, f"a\n{unit.upper()}\nb"), (2, f"{unit}\né {other}"), (8, None), (9, ""), (None, unit), (10, "short\nshort"), (11, "one two three\n" * 40), (12, f"{unit}\n{unit}x {unit}"), (13, long), (14, f"{long} tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = _collected(substring_dedup(docs))
    assert got[5][0] == "a\nb" and got[2][0] == rows[1][1] and got[8] == (None, []) and got[9] == ("", []) and got[None] == (unit, [])
    assert got[11][0] == rows[6][1]  # three words over and over are no passage
    assert got[13][0] == long and got[14][0].endswith(" tail") and len(got[14][0]) < 400  # but for the piece that goes on
    assert {k: v for k, v in got.items() if k is not None and k != 8} == brute.substring_dedup([x for x in rows if x[0] is not None and x[1] is not None])
    twice = substring_dedup(docs.unionByName(docs))
    assert twice.count() == 2 * len(rows) and _collected(twice) == got
    assert substring_dedup(docs.limit(0)).collect() == []


def test_clashing_names(spark):
    names = ["id_", "text_", "unit_", "again_", "keeper_", "last_", "gone_", "removed_", "Removed__", "a.b", "digest"]
    unit = _words(1, 30)
    docs = spark.createDataFrame([(1, unit, *range(len(names))), (2, f"x {unit}", *range(10, 10 + len(names)))], ["doc_id", "text", *names])
    got = substring_dedup(docs)
    assert got.columns == [*docs.columns, "removed___"] and removed_name(docs.columns) == "removed___"
    found = {r[0]: tuple(r) for r in got.collect()}
    assert found[1][2:-1] == tuple(range(len(names))) and found[2][2:-1] == tuple(range(10, 10 + len(names))) and len(found[2][-1]) == 1


def test_other_ids(spark):
    unit = _words(1, 30)
    for kind, a, b in (("string", "a", "b"), ("int", 1, 2)):
        docs = spark.createDataFrame([(a, unit), (b, unit)], f"Doc_ID {kind}, text string")
        got = {r[0]: (r.text, [x.keeper for x in r.removed_]) for r in substring_dedup(docs, id_col="doc_id").collect()}
        assert got == {a: (unit, []), b: ("", [a])}


def test_pieces_are_cut_alike_anywhere():
    words, passage = Words(), _words(9, 200)
    alone = {bytes(x) for x in units_of(pieces_of(passage, words), 25)[0].reshape(-1, 1)}
    inside = {bytes(x) for x in units_of(pieces_of(f"{_words(10, 33)} {passage} {_words(11, 7)}", words), 25)[0].reshape(-1, 1)}
    assert len(alone & inside) >= len(alone) - 3
