import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillspark.llm.mixing import mix_sources  # noqa: E402
from quillspark.llm.sql import WEIGHTS  # noqa: E402

from .brute import jaccard  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
        if name != "tokens":
            assert docs.columns == before.columns
    before, after = seen["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = before.keys() - after.keys()
    assert gone and sum(labels.get(i, 1) for i in gone) >= 0.8 * len(gone)
    before, after = seen["line_dedup"]
    assert all(set(r.text.split("\n")) <= set(before[i].text.split("\n")) for i, r in after.items())
    before, after = seen["near_duplicates"]
    groups = jaccard({i: r.text for i, r in before.items()}, 5, 80)
    assert after.keys() == {i for i, (_, root) in groups.items() if i == root}
    before, after = seen["mixing"]
    assert before == after
    before, after = seen["tokens"]
    assert before.keys() == after.keys()
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == after


def test_tokens_come_in_the_order_of_the_mix(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    documents.orderBy("doc_id").limit(90).repartition(9).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted((r.slot_, r.start_, r.doc_id) for r in mix_sources(docs, WEIGHTS).collect())
    assert [(r.slot, r.start, r.doc_id) for r in corpus_pipeline.tokens(spark, docs, SF).collect()] == want


def test_run_on_several_files_keeps_the_mix(spark):
    name = "spark.sql.files.maxRecordsPerFile"
    spark.conf.set(name, "15")
    try:
        found = [(r.slot, r.start) for r in corpus_pipeline.run(spark, SF).collect()]
    finally:
        spark.conf.unset(name)
    assert len(found) > 100 and found == sorted(set(found))


def test_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g", None, None, None), (2, None, "en", "src1", 0), (None, "x", "en", "src1", 1), (3, "", "en", None, 0), (4, "a b c d e f g", "en", "src2", 2), (4, "a b c d e f g", "en", "src2", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert sorted(map(str, (r.doc_id for r in docs.collect()))) == ["1", "2", "3", "None"]
