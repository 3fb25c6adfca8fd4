"""Queries of the evaluation on letters whose case mappings are special."""

import duckdb
import pytest

from quillspark import catalog

TEXTS = ("Ein Fuß", "Erß", "Heß", "xßy", "İİi", "ΑΣΑ", "aας", "ΑΣ", "ᾳᾼᾳ", "ŉŉn", "xﬁy", "aάb", "", "ß", None, "ẞßẞ", "xé𐐨𐐀")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("graded")
    spark.createDataFrame([(i, x, "de") for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", ["eval_errors", "eval_match", "eval_binary"])
def test_special_letters_equal_sql(spark, tables, name):
    d, con = tables
    got, want = catalog.QUERIES[name](spark, d), con.sql(catalog.ORACLES[name])
    columns = ", ".join(got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.project(columns).fetchall()))
