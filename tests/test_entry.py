import json
import subprocess
import sys
import time
from pathlib import Path

from quillspark import cli
from quillspark.operators import lexicon
from quillspark.plans.components import connected_components
from quillspark.streaming import match_stream

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_queries(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and e.oracle_sql().keys() <= e.queries().keys()


def test_imports_without_the_optional_parts(tmp_path):
    for p in ("quillspark", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p) if p.endswith(".py") else _linked(tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'mention_counts' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def _linked(tmp_path):
    (tmp_path / "quillspark").mkdir()
    for x in (ROOT / "quillspark").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "quillspark" / x.name).symlink_to(x)


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 1), (3, 2), (2, 3), (3, 2)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {2: 2, 3: 2}
    assert connected_components(edges.limit(0)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a data set"), (2, "none")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = match_stream(spark, str(tmp_path / "in"), lexicon.keyword_rows(spark)).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    time.sleep(0.5)
    assert sorted(r.phrase for r in spark.table("hits").collect()) == ["data", "data set"]


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.txt").write_text("We release the data set. Version 2.0 of the model.\nThe MIT License, version 1.0, NLP data.")
    assert cli.main(["--input_dir", str(tmp_path / "in"), "--output_dir", str(tmp_path / "out"), "--text_mode", "--split_sentences", "--perform_deduplication", "--reevaluate", "--thresholds", '{"valid_score": 0.1}']) == 0
    assert spark.read.parquet(str(tmp_path / "out/mentions")).count() > 3
    assert (tmp_path / "out/reevaluated/artifacts").exists()
    assert cli.main(["--input_dir", str(tmp_path / "in"), "--output_dir", str(tmp_path / "fast"), "--text_mode", "--fast_mode", "--compress_output"]) == 0
    assert spark.read.json(str(tmp_path / "fast/fast")).count() == 1


def test_gazetteer_flags(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "doc.txt").write_text("We used BIOBREAD here.\nThe MIT License of Breadcrumb, version 1.0, covers the data.")
    spark.createDataFrame([("biobread", ["Dataset"]), ("biobread", ["Method"])], "phrase string, types array<string>").write.parquet(str(tmp_path / "gaz/hybrid"))
    base = ["--input_dir", str(tmp_path / "in"), "--text_mode", "--output_dir"]
    assert cli.main([*base, str(tmp_path / "out"), "--dataset_gazetteers", "hybrid", "--gazetteer_dir", str(tmp_path / "gaz"), "--insert_fast_mode_gazetteers"]) == 0
    found = spark.read.parquet(str(tmp_path / "out/mentions")).collect()
    assert {r.kind for r in found if r.phrase == "biobread"} == {"gaz_dataset", "gaz_method"}


def test_reports_of_parsed_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = "<div><head>Data</head><p><s>We release the NLP data set under the MIT License, version 2.0.</s><s>It extends <ref type='bibr' target='#b1'>[1]</ref>.</s></p></div>"
    back = "<biblStruct xml:id='b0'><analytic><title>Self</title></analytic></biblStruct><biblStruct xml:id='b1'><analytic><title>Other</title></analytic></biblStruct>"
    (tmp_path / "in" / "one.xml").write_text(f"<TEI><titleStmt><title>One</title></titleStmt><text><body>{body}</body><back>{back}</back></text></TEI>")
    (tmp_path / "in" / "two.xml").write_text("<TEI><text><body/></text></TEI>")
    out, again = str(tmp_path / "out"), str(tmp_path / "again")
    assert cli.main(["--input_dir", str(tmp_path / "in"), "--output_dir", out, "--xml_mode", "--perform_deduplication"]) == 0
    assert cli.main(["--input_dir", out, "--output_dir", again, "--xml_mode", "--reevaluate_only", "--thresholds", '{"valid_score": 0.1}']) == 0
    reports = {r.doc_id: json.loads(r.report) for r in spark.read.json(f"{again}/reevaluated/report").collect()}
    assert reports.keys() == {"one", "two"} and reports["one"]["publication_info"]["title"] == "One"
    assert [c["title"] for c in reports["one"]["citations"]] == ["Other"] and [c["target"] for c in reports["one"]["citances"]] == ["#b1"]
    assert {m["trigger"] for m in reports["one"]["mentions"]} >= {"data set"} and "mentions" not in reports["two"]
    for name in ("artifacts", "mentions", "publication_info", "citations", "citances"):
        assert spark.read.parquet(f"{again}/reevaluated/{name}").count() >= 1
