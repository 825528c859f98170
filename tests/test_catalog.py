"""Every query with an oracle gives DuckDB's rows."""

import os

import duckdb
import pytest

from pageflow import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(map(repr, pdf.where(pdf.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = con.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_language_accuracy(spark, sf):
    p = catalog.queries()["lang_detect"](spark, sf).toPandas()
    assert (p["lang"] == p["detected"]).mean() > 0.9


def test_language_detection_gives_every_document(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = docs.where("lang = 'de' and n_chars > 300").first()["text"]
    extra = spark.createDataFrame([(None, text), (None, None), (-7, text), (-7, "???")], "doc_id long, text string")
    docs.unionByName(extra, allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["lang_detect"](spark, str(tmp_path)).collect()
    assert len(got) == docs.count() + 4
    assert sorted(r["detected"] for r in got if r["doc_id"] is None) == ["", "de"]
    assert sorted(r["detected"] for r in got if r["doc_id"] == -7) == ["", "de"]
    assert {r["fold"] for r in got} == {0, 1}
