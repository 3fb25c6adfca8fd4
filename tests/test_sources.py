import json

import pytest

from quillspark.operators import evaluate, report, segment
from quillspark.sources import readers, writers

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>A Paper</title></titleStmt>
<sourceDesc><biblStruct xml:id="b0"><idno type="DOI">10.1/ABC</idno><analytic><title>Self</title><author><persName><forename>Ann</forename><surname>Lee</surname></persName></author></analytic></biblStruct>
<idno type="MD5">x1</idno></sourceDesc></fileDesc><profileDesc>{abstract}</profileDesc></teiHeader>
<text><body><div><head>Intro</head><p><s>First one.</s><s>See <ref type="bibr" target="#b1">[1]</ref>.</s></p></div><div><p/></div>
<figure xml:id="f0"><head>Fig</head><figDesc>desc</figDesc><div><p><s>In a figure.</s></p></div></figure><formula xml:id="m0">x=y</formula></body>
<back><biblStruct xml:id="b1"><analytic><title>Other</title></analytic></biblStruct></back></text></TEI>"""


def test_tei(spark, tmp_path):
    (tmp_path / "one.xml").write_text(TEI.format(abstract="<abstract><div><p><s>Sum.</s></p></div></abstract>"))
    (tmp_path / "two.xml").write_text(TEI.format(abstract=""))
    (tmp_path / "bad.xml").write_text("<no")
    (tmp_path / "skip.txt").write_text("x")
    docs = readers.tei_documents(spark, str(tmp_path))
    got = {r.doc_id: r for r in docs.collect()}
    assert got.keys() == {"one", "two", "bad"} and got["bad"].sections is None and got["two"].abstract is None
    one = got["one"]
    assert one.title == "A Paper" and one.abstract == [["Sum."]] and [tuple(x) for x in one.identifiers] == [("DOI", "10.1/ABC"), ("MD5", "x1")]
    assert [(s.title, s.paragraphs) for s in one.sections if s.paragraphs != [["Sum."]]] == [("Intro", [["First one.", "See [1]."]]), (None, [[]]), ("Fig", [["In a figure."]])]
    assert [(b.id, b.doi, b.title) for b in one.bibl_references] == [("b0", "10.1/abc", "Self"), ("b1", None, "Other")]
    assert one.citances[0].refs[0].target == "#b1" and one.citances[0].sentence == "See [1]." and one.figures[0].desc == "desc" and one.formulas[0].desc == "x=y"
    assert segment.sentences_of_sections(docs).where("doc_id = 'two'").count() == 3
    info = {r.doc_id: r for r in report.publication(docs).collect()}
    assert info["one"].authors == "Ann Lee" and info["one"].sections == "Intro\nFig" and info["bad"].authors == ""
    refs = docs.selectExpr("doc_id", "posexplode(bibl_references) AS (ref_ord, r)").selectExpr("doc_id", "ref_ord", "r.*")
    linked = report.citances_with_references(report.citances(docs.selectExpr("doc_id", "inline(citances)")), report.citations(refs)).collect()
    assert {(r.target, r.ref_title) for r in linked} == {("#b1", "Other")}


def test_citance_scores(spark):
    ref = "struct<target:string,type:string,text:string,intent:string,intent_probs:map<string,double>>"
    rows = [("d", 0, 0, 0, "s", [("#b1", "bibr", "[1]", "use", {"use": 0.75}), ("#b2", None, None, "use", {"other": 0.5}), (None, None, None, None, None)])]
    got = report.citances(spark.createDataFrame(rows, f"doc_id string, sec_idx int, par_idx int, s_idx int, sentence string, refs array<{ref}>")).collect()
    assert [(r.target, r.intent, r.intent_score, r.polarity, r.polarity_score) for r in got] == [("#b1", "use", "0.75", "Skipped", "Skipped"), ("#b2", "use", "", "Skipped", "Skipped"), ("", "", "", "Skipped", "Skipped")]


def test_text_files_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("One. Two.\nThree")
    (tmp_path / "b.md").write_text("x")
    whole = readers.text_files(spark, str(tmp_path), "*.txt").collect()
    assert [(r.doc_id, r.text_list) for r in whole] == [("a", [["One. Two.\n", "Three"]])]
    split = segment.sentences_of_lists(readers.text_files(spark, str(tmp_path), "*.txt", split=True), split=True)
    assert sorted((r.par, r.sent, r.text) for r in split.collect()) == [(0, 0, "One."), (0, 1, "Two."), (1, 0, "Three")]
    lists = readers.text_lists(spark, [[["a b.", "c"]], []])
    assert segment.sentences_of_lists(lists).count() == 2


def test_sentence_splitting(spark):
    docs = spark.createDataFrame([(1, "Hi Mr. Smith. See e.g. Fig. 2! Yes?  No... end"), (2, ""), (3, None)], "doc_id long, text string")
    assert [r.text for r in segment.sentences_of_texts(docs).orderBy("sent").collect()] == ["Hi Mr. Smith.", "See e.g. Fig. 2!", "Yes?", "No...", "end"]


def test_parquet_documents(spark, tmp_path):
    literal = "[['T', [['s1', 's2']]], [None, [['s3']]]]"
    spark.createDataFrame([(1, literal), (2, "__import__('os')"), (3, None)], "id long, sections string").write.parquet(str(tmp_path / "text"))
    got = {r.doc_id: r.sections for r in readers.parquet_documents(spark, str(tmp_path / "text")).collect()}
    assert [(s.title, s.paragraphs) for s in got["1"]] == [("T", [["s1", "s2"]]), (None, [["s3"]])] and got["2"] is None and got["3"] is None
    readers.parquet_documents(spark, str(tmp_path / "text")).withColumnRenamed("doc_id", "id").write.parquet(str(tmp_path / "nested"))
    nested = {r.doc_id: r.sections for r in readers.parquet_documents(spark, str(tmp_path / "nested")).collect()}
    assert nested == got


def test_doi_documents_and_results(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"doi": "10.1/x", "sections": [["T", [["s"]]]]}) + "\n" + json.dumps({"doi": "10.1/y", "sections": [{"title": "U", "paragraphs": [["t"]]}]}))
    got = {r.doc_id: r.sections for r in readers.doi_documents(spark, str(tmp_path / "d.json")).collect()}
    assert got["10.1/y"][0].title == "U" and got["10.1/x"][0].paragraphs == [["s"]]
    rows = spark.createDataFrame([("d1", "C0"), ("d2", "C1")], "doc_id string, mention_id string")
    for compress in (False, True):
        writers.write_results(rows, str(tmp_path / f"out{compress}"), compress)
        assert sorted((r.doc_id, r.mention_id) for r in readers.results(spark, str(tmp_path / f"out{compress}")).collect()) == [("d1", "C0"), ("d2", "C1")]


def test_gazetteer_files(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"name": "BERT ", "full_name": "Bidirectional"}, {"name": "", "full_name": None}]))
    (tmp_path / "p.txt").write_text(" corpus \n\ntool\n")
    from quillspark.operators.lexicon import flatten_methods, gazetteer_rows, merge, select_external

    methods = flatten_methods(readers.gazetteer_methods(spark, str(tmp_path / "m.json")))
    assert {r.phrase for r in methods.collect()} == {"BERT", "Bidirectional"}
    rows = gazetteer_rows(merge(methods, methods.limit(0)), 5).orderBy("rank").collect()
    assert [(r.rank, r.phrase, r.kind) for r in rows] == [(5, "BERT", "gaz_method"), (6, "Bidirectional", "gaz_method")]
    assert [r.phrase for r in readers.phrase_list(spark, str(tmp_path / "p.txt")).collect()] == ["corpus", "tool"]
    assert select_external(None, methods, methods) is None
    with pytest.raises(ValueError):
        select_external("other", methods, methods)


def test_requests():
    assert readers.load_request('{"text_list": [["a"]], "fast_mode": true}')["fast_mode"] is True
    for bad in ("{}", '{"text_list": null}', '{"text_list": ["a"]}', '{"text_list": [], "fast_mode": "x"}', '{"text_list": [], "dataset_gazetteers": "x"}'):
        with pytest.raises(ValueError):
            readers.load_request(bad)


def test_evaluation(spark):
    cols = ["valid", "name", "version", "license", "url", "ownership", "usage"]
    ddl = ", ".join(f"pred_{c} string, gold_{c} string" for c in cols)
    rows = [("Yes", "Yes", "BERT", "bert", "N/A", "1", "MIT", "MIT License", "N/A", "N/A", "Yes", "No", "Yes", "Yes"), ("Yes", "No", *["N/A"] * 8, *["No"] * 4), ("No", "Yes", *["N/A"] * 8, *["No"] * 4)]
    got = {r.field: r for r in evaluate.evaluate(spark.createDataFrame(rows, ddl)).collect()}
    assert (got["valid"].tp, got["valid"].fp, got["valid"].fn, got["valid"].f1) == (1, 1, 1, 0.5)
    assert (got["name"].exact, got["license"].exact, got["license"].lenient, got["version"].fn, got["ownership"].fp, got["url"].f1) == (1.0, 0.0, 1.0, 1, 1, 0.0)
    assert json.loads(evaluate.metrics_json(evaluate.evaluate(spark.createDataFrame(rows, ddl))).head().metrics)["valid"]["f1"] == 0.5
    wrong = evaluate.errors(spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], f"item string, {ddl}")).collect()
    assert {(r.item, r.field, r.kind) for r in wrong} == {("0", "version", "binary"), ("0", "license", "exact"), ("0", "ownership", "binary"), ("1", "valid", "binary"), ("2", "valid", "binary")}
    assert [(r.gold, r.pred) for r in wrong if r.kind == "exact"] == [("MIT License", "MIT")]


def test_service(spark):
    from quillspark.service import infer_text_list

    body = {"text_list": [["this dataset is called BIOMRC"], ["BIOREAD is a dataset used to train the new MRC models"]]}
    status, answer = infer_text_list(spark, json.dumps(body))
    found = answer["research_artifacts"]["candidates_metadata"]
    assert status == 200 and [(m["phrase"], m["par"], m["start"], m["end"]) for m in found.values()] == [("dataset", 0, 5, 12), ("dataset", 1, 13, 20), ("models", 1, 47, 53)]
    status, answer = infer_text_list(spark, json.dumps(body | {"fast_mode": True}))
    assert status == 200 and answer["research_artifacts"][1]["Candidates"] == "[dataset] : dataset | [software] : models"
    assert infer_text_list(spark, json.dumps({"text_list": []}))[0] == 200
    assert infer_text_list(spark, json.dumps(body | {"insert_fast_mode_gazetteers": True, "perform_deduplication": True}))[0] == 200
    for bad in ({}, {"text_list": None}, {"text_list": [1]}):
        assert infer_text_list(spark, json.dumps(bad))[0] == 422


def test_multilabel(spark):
    from quillspark.functions.text import common, multilabel_logits, united

    row = spark.sql("SELECT map('a', array(array(named_struct('token', 'Yes', 'logit', 1D), named_struct('token', 'No', 'logit', 1D))), 'b', array(array(named_struct('token', 'No', 'logit', 2D)))) AS m, array(1, 2) AS x, array(2, 3) AS y")
    got = row.select(multilabel_logits("m").alias("p"), common("x", "y").alias("c"), united("x", "y").alias("u")).head()
    assert got.p == {"a": 0.5, "b": 0.0} and got.c == [2] and got.u == [1, 2, 3]
