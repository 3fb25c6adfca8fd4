"""The operators that SQL can express, against DuckDB and on odd rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, sql
from quillspark.llm.line_spread import Spread, boilerplate_lines, lines_of, remove_boilerplate
from quillspark.llm.mixing import OTHER, frame_of, in_mixed_order, mix_sources, place_names
from quillspark.llm.url_lists import filter_urls, intervals, keys_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))


def test_boilerplate(spark):
    rows = [(i, f"head {i}\n  cookie notice \n\nbody {i}", f"s{i % 4}") for i in range(8)]
    rows += [(20, None, "s1"), (21, "", None), (None, "cookie notice", "s9"), (22, "cookie notice", "s1"), (22, "cookie notice", "s1"), (23, "rare\nrare", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS digest_x", "2 AS removed")
    got = sorted(map(tuple, remove_boilerplate(docs, Spread(min_sites=4)).select("doc_id", "text", "removed_").collect()), key=repr)
    want = [(0, rows[0][1], 0)] + [(i, f"head {i}\n\nbody {i}", 1) for i in range(1, 8)]
    want += [(20, None, 0), (21, "", 0), (None, "cookie notice", 0), (22, "", 1), (22, "", 1), (23, "rare\nrare", 0)]
    assert got == sorted(want, key=repr)
    assert remove_boilerplate(docs, Spread(min_sites=5)).where("removed_ > 0").count() == 0
    assert remove_boilerplate(docs.limit(0)).collect() == []


def test_only_near_lines_are_counted_exactly(spark):
    rows = [(s, "near\nfar" if s < 10 else "far", f"site{s}") for s in range(60)]
    lines = lines_of(spark.createDataFrame(rows, "doc_id long, text string, source string")).withColumn("digest_", F.unhex(F.md5("line_")))
    found = boilerplate_lines(lines, Spread())
    assert found.count() == 2
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    distinct = next(i for i, x in enumerate(plan) if "Aggregate [digest_" in x and "site_" in x)
    assert any("Join LeftSemi" in x for x in plan[distinct + 1 : distinct + 3])


@pytest.mark.parametrize("name", ["id_", "gone_", "gone_id_", "removed_", "digest_", "first_", "site_", "at_", "line_", "a.b"])
def test_boilerplate_with_clashing_names(spark, name):
    rows = [(i, f"head {i}\nnotice", f"s{i}", i * 11) for i in range(6)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", name])
    got = remove_boilerplate(docs, Spread(min_sites=4))
    assert got.columns == [*docs.columns, "removed__" if name == "removed_" else "removed_"]
    assert sorted(map(tuple, got.collect())) == [(i, f"head {i}" + "\nnotice" * (i == 0), f"s{i}", i * 11, int(i > 0)) for i in range(6)]


def test_boilerplate_in_very_long_texts(spark):
    body = "\n".join(f"own line {i}" for i in range(60_000))
    docs = spark.createDataFrame([(i, f"{body}\nnotice\n{i}", f"s{i}") for i in range(4)], "doc_id long, text string, source string")
    got = {r.doc_id: (r.removed_, r.text) for r in remove_boilerplate(docs, Spread(min_sites=4)).collect()}
    assert got[0][0] == 0 and all(got[i] == (60_001, str(i)) for i in (1, 2, 3))


PLACES = ["group_", "block_", "slot_", "start_", "key_", "size_", "range_", "sum_", "total_", "wide_", "base_", "within_", "p_", "q_", "j_", "at_", "i_", "a.b"]


def test_mix_with_clashing_names(spark):
    rows = [(i, "x" * (i % 7 * 10), "a" if i % 3 else "b") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r.doc_id, r.slot_, r.start_) for r in mix_sources(docs, {"a": 2, "b": 1}, block_chars=100).collect())
    wide = spark.createDataFrame([(*r, *range(r[0], r[0] + len(PLACES))) for r in rows], ["doc_id", "text", "source", *PLACES])
    got = mix_sources(wide, {"a": 2, "b": 1}, block_chars=100)
    assert got.columns == [*wide.columns, "group__", "block__", "slot__", "start__"] and place_names(wide.columns) == got.columns[-4:]
    assert all(tuple(r)[3 : 3 + len(PLACES)] == tuple(range(r.doc_id, r.doc_id + len(PLACES))) for r in got.collect())
    assert sorted((r.doc_id, r.slot__, r.start__) for r in got.collect()) == want
    assert in_mixed_order(wide, {"a": 2, "b": 1}).columns == wide.columns


def test_one_id_of_many_rows_and_long_texts(spark):
    rows = [(1, "x" * i, "a") for i in range(300)] + [(2, "y" * 3_000_000, "a"), (3, "z", "b")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"a": 2, "b": 1}, block_chars=100).collect()
    begin = sorted((r.block_ * 100 + r.start_, len(r.text) + 1) for r in got if r.group_ == "a")
    assert begin[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(begin, begin[1:]))


def test_far_estimates_and_near_counts_agree(spark):
    rows = [(s * 1000 + k, f"line of {n} sites", f"site{s}") for k, n in enumerate((3, 19, 20, 21, 200)) for s in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    gone = {r.text for r in docs.join(remove_boilerplate(docs, Spread(min_sites=20)).where("removed_ > 0").select("doc_id"), "doc_id").collect()}
    assert gone == {"line of 20 sites", "line of 21 sites", "line of 200 sites"}


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 3, "b": 2, "c": 2}, sql.WEIGHTS | {OTHER: 1}, {"a": 7, "b": 1, "c": 1, "d": 1}])
def test_frames_stay_within_a_block(spark, weights):
    frame = sorted(frame_of(spark, weights).collect(), key=lambda r: r.at_)
    assert [(r.group_, r.j_, r.at_) for r in frame] == sql.earliest_deadline_first(weights)
    q, done = sum(weights.values()), dict.fromkeys(weights, 0)
    for slot, r in enumerate(frame):
        done[r.group_] += 1
        assert all(abs(done[s] - (slot + 1) * weights[s] / q) < 1 for s in weights)
    assert done == weights


def test_mix_of_odd_rows(spark):
    rows = [(i, "x" * (i % 7 * 10), "a" if i % 3 else "b") for i in range(200)] + [(None, None, None), (3, "", "zz"), (3, "", "zz"), (4, "y" * 5000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS key", "2 AS slot")
    got = mix_sources(docs, {"a": 2, "b": 1}, block_chars=100).collect()
    assert sorted(((r.doc_id, r.text, r.source) for r in got), key=repr) == sorted(rows, key=repr)
    assert {r.group_ for r in got if r.source in (None, "zz")} == {OTHER}
    assert len({(r.slot_, r.start_) for r in got}) == len(rows) and all(0 <= r.start_ < 100 for r in got)
    assert mix_sources(docs.limit(0), {"a": 1}).collect() == []
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0})


def test_url_intervals(spark):
    lines = [("l", "Bad.org", "block", "add", "2024-01-05"), ("l", "Bad.org", "block", "remove", "2024-01-10"), ("l", "bad.org/ok", "allow", "add", "2024-01-01"), ("l", "same.org", "block", "remove", "2024-01-03"), ("l", "same.org", "block", "add", "2024-01-03"), (None, "x.org", "block", "add", "2024-01-01")]
    entries = spark.createDataFrame(lines, "list string, key string, verdict string, action string, day string").selectExpr("list", "key", "verdict", "action", "CAST(day AS date) AS day")
    assert sorted((r.key, str(r.since), str(r.until)) for r in intervals(entries).collect()) == [("bad.org", "2024-01-05", "2024-01-10"), ("bad.org/ok", "2024-01-01", "None"), ("same.org", "2024-01-03", "None")]
    at = [(1, "http://a.bad.org:80/ok/x?y#z", "2024-01-06"), (2, "//BAD.org/ok/x", "2024-01-06"), (3, "http://bad.org", "2024-01-04"), (4, "http://bad.org/", "2024-01-10"), (5, None, "2024-01-06"), (6, "not a url", "2024-01-06"), (7, "http://same.org", "2024-01-03"), (7, "http://same.org", "2024-01-03"), (None, "http://u:p@bad.org/q", "2024-01-05"), (8, "http://same.org", None), (9, "http://notbad.org", "2024-01-06")]
    captures = spark.createDataFrame(at, "page_id long, url string, day string").selectExpr("page_id", "url", "CAST(day AS date) AS day", "1 AS n", "2 AS best", "'k' AS key")
    got = sorted(((r.page_id, r.n_active, r.verdict, r.matched_key) for r in filter_urls(captures, entries).collect()), key=repr)
    want = [(1, 1, "block", "bad.org"), (2, 2, "allow", "bad.org/ok"), (3, 0, "none", None), (4, 0, "none", None), (5, 0, "none", None), (6, 0, "none", None), (7, 1, "block", "same.org"), (7, 1, "block", "same.org"), (None, 1, "block", "bad.org"), (8, 0, "none", None), (9, 0, "none", None)]
    assert got == sorted(want, key=repr)
    assert filter_urls(captures.limit(0), entries).collect() == [] and filter_urls(captures, entries.limit(0)).count() == len(at)
    assert captures.where("page_id = 1").select(keys_of("url").alias("k")).head().k == ["a.bad.org", "bad.org", "org", "a.bad.org/ok", "a.bad.org/ok/x"]


def test_url_keys_of_odd_forms(spark):
    lines = [("EX.org/Path", "block"), ("ex.ORG/lower/", "block"), ("[::1]/a", "block"), ("10.0.0.1", "allow"), ("0.0.1", "block"), ("1", "block")]
    entries = spark.createDataFrame([("l", k, v, "add") for k, v in lines], "list string, key string, verdict string, action string").selectExpr("*", "DATE'2024-01-01' AS day")
    urls = {1: "http://ex.org/Path/x", 2: "http://ex.org/path/x", 3: "http://EX.org/lower", 4: "http://[::1]:80/a/b", 5: "http://10.0.0.1/x", 6: "http://ex.org/LOWER", 7: "http://ex.org/" + "p/" * 3000}
    captures = spark.createDataFrame(list(urls.items()), "page_id long, url string").selectExpr("*", "DATE'2024-02-01' AS day")
    got = {r.page_id: (r.verdict, r.matched_key) for r in filter_urls(captures, entries).collect()}
    none = ("none", None)
    assert got == {1: ("block", "ex.org/Path"), 2: none, 3: ("block", "ex.org/lower"), 4: ("block", "[::1]/a"), 5: ("allow", "10.0.0.1"), 6: none, 7: none}
