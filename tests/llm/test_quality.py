"""Operator 12: features and counts by hand, the dual's optimum, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import op12_quality as Q


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


@pytest.fixture(scope="module")
def model(tables):
    return Q.train(*tables, Q.fifth())


def test_held_out_accuracy(tables, model):
    docs, labels = tables
    p = Q.score(docs, model).join(labels, "doc_id").where(Q.fifth()).toPandas()
    good = p["quality"] == 1
    assert len(p) > 50 and p["score"].between(0, 1).all()
    assert ((p["score"] >= 0.3) == good).mean() > 0.97
    assert p[good]["score"].min() > p[~good]["score"].median()


def test_only_the_text_is_scored(spark, tables, model):
    docs = tables[0].limit(50)
    other = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("yy").alias("source"))
    a = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    b = {r["doc_id"] - 1_000_000: r["score"] for r in Q.score(other, model).collect()}
    assert a == b and len(a) == 50


def test_held_out_labels_teach_nothing(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("quality", F.when(Q.fifth(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [Q.score(docs.limit(40), Q.train(docs, x, Q.fifth())).orderBy("doc_id").collect() for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_features_are_ngrams_once():
    find = Q.Features()
    one = find.of("Good words here!! Good words here!!")
    assert one.tolist() == sorted(set(one.tolist()))
    # eight tokens: the same single tokens and pairs as in the first half but for the pair across
    half = find.of("Good words here!!")
    assert set(half.tolist()) <= set(one.tolist()) and len(one) > len(half)
    assert find.of("") .size == find.of(None).size == find.of(" \n").size == 0
    assert find.of("a").size == 2  # a token and a shape
    find.ids.clear()
    assert Q.Features().of("Good words here!!").tolist() == half.tolist()


def test_counts_and_ratios(spark, tables):
    docs, labels = tables
    rows = Q.labelled(docs, labels, Q.fifth(), "quality", "doc_id", "text")
    got = {r["bucket"]: (r["a"], r["b"]) for r in Q.gather(rows, 0.0).groupBy("bucket").agg(F.sum("zeros").alias("a"), F.sum("ones").alias("b")).collect()}
    want, find = {}, Q.Features()
    for r in rows.collect():
        for k in find.of(r["text"]).tolist():
            a, b = want.get(k, (0, 0))
            want[k] = (a + (r["label"] == 0), b + (r["label"] == 1))
    assert got == want
    counts = np.array([[3, 0, 1], [0, 5, 1]])
    p = (counts[1] + 1) / (counts[1] + 1).sum()
    q = (counts[0] + 1) / (counts[0] + 1).sum()
    assert np.allclose(Q.ratios(counts), np.log(p / q))


def test_the_dual_is_solved(monkeypatch):
    """No step from the weights found makes the primal objective smaller."""
    monkeypatch.setattr(Q, "BUCKETS", 6)
    monkeypatch.setattr(Q, "PASSES", 3000)
    monkeypatch.setattr(Q, "TOLERANCE", 1e-9)
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(40)]
    y = np.where(rng.random(40) < 0.3, -1, 1)
    r = rng.normal(size=6)
    w = Q.fit(rows, y, r)
    x = np.zeros((40, 7))
    for i, (at, v) in enumerate(zip(rows, Q._scaled(rows, r))):
        x[i, np.append(at, 6)] = v
    cost = Q.COST * 40 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    best = loss(w)
    assert all(loss(w + rng.normal(size=7) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_odd_rows(spark, docs, model):
    out = Q.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert sum(r["doc_id"] is None for r in out) == 1
    blank = {r["score"] for r in out if r["doc_id"] in (1, 2, 4)}
    assert len(blank) == 1  # null, empty and white space alike
    twice = [r["score"] for r in out if r["doc_id"] == 5]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_labels_of_one_kind_or_none(spark, docs, none):
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, extra string, text string")
    no = F.lit(False)
    for rows, want in (([], 0.5), ([(0, 1, "", ""), (7, 1, "", ""), (None, 0, "", ""), (9, None, "", "")], 1.0), ([(0, 0, "", "")], 0.0)):
        assert {r["score"] for r in Q.score(docs, Q.train(docs, labels(rows), no)).collect()} == {want}
    both = Q.train(docs, labels([(0, 1, "", ""), (0, 0, "", ""), (5, 0, "", ""), (3, 1, "", "")]), no)
    assert both.w is not None and Q.score(none, both).collect() == []
    assert Q.train(none, labels([(0, 1, "", "")]), no).constant == 0.5
