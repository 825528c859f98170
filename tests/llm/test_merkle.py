"""Operator 11 against trees that are built one by one."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pageflow.llm import op11_merkle as M


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"] + more if row["n_chars"] is not None else None, row["text"]):
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return digest(out)


def levels_of(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, at, h, fanout):
    """The siblings on the way to the root, and what h folds to."""
    path = []
    for level in levels[:-1]:
        start = at - at % fanout
        left, right = level[start:at], level[at + 1 : start + fanout]
        path += left + right
        h = digest([*left, h, *right])
        at //= fanout
    return path, h


def by_hand(rows, tampered, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[name] = levels_of([leaf(r) for r in groups[name]], fanout)
    top = levels_of([trees[n][-1][0] for n in names], fanout)
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path, h = climb(trees[name], i, leaf(r, 1) if tampered(r) else leaf(r), fanout)
            more, h = climb(top, k, h, fanout)
            out.append((r["doc_id"], leaf(r), trees[name][-1][0], top[-1][0], digest(path + more), h, h == top[-1][0]))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect())


def seventh(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0


@pytest.mark.parametrize("fanout,block,step", [(2, 1 << 12, 6), (2, 4, 1), (3, 9, 2), (16, 16, 1)])
def test_trees_of_a_table(spark, sample, monkeypatch, fanout, block, step):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "STEP", step)
    monkeypatch.setattr(M, "RANGE_ROWS", 23)  # many ranges, none aligned
    assert got(M.verify_documents(sample, fanout=fanout)) == by_hand(sample.collect(), seventh, fanout)


def test_odd_rows(spark, docs, monkeypatch):
    """Nulls, repeated rows, a group without a name, one of a single row, one whose name is empty."""
    lang = F.when(F.col("doc_id") == 5, None).when(F.col("doc_id") == 3, "zz").when(F.col("doc_id") == 4, "").otherwise(F.col("lang"))
    rows = docs.withColumn("lang", lang).withColumn("grp", F.lit(1)).withColumn("idx", F.lit("x")).withColumn("n_chars", F.when(F.col("doc_id") != 6, F.col("n_chars")))
    monkeypatch.setattr(M, "RANGE_ROWS", 3)
    assert got(M.verify_documents(rows)) == by_hand(rows.collect(), seventh, 2)


def test_one_id_for_all_rows(spark, monkeypatch):
    rows = spark.range(500).selectExpr("7L as doc_id", "'t' as text", "'en' as lang", "'s' as source", "1L as n_chars")
    monkeypatch.setattr(M, "RANGE_ROWS", 20)
    out = M.verify_documents(rows)
    assert out.count() == 500 and got(out) == by_hand(rows.collect(), seventh, 2)


def test_empty(none):
    assert M.verify_documents(none).collect() == []


def test_every_node_is_a_record_once(spark, sample, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 10)
    m = M.manifest(M.document_leaves(sample, M.seventh()))
    for r in m.trees.roots.collect():
        of = m.trees.nodes.where(F.col("grp") == r["grp"])
        width, want = r["n"], []
        while width > 1:
            want.append(width)
            width = -(-width // 2)
        want.append(1)
        assert [x["count"] for x in of.groupBy("level").count().orderBy("level").collect()] == want
        assert of.select("level", "idx").distinct().count() == sum(want)


def test_a_changed_row_is_found(spark, sample):
    out = M.verify_documents(sample, F.col("doc_id") == 3).where("not verified").collect()
    assert [r["doc_id"] for r in out] == [3]


def test_missing_nodes_are_an_error(spark):
    with pytest.raises(ValueError, match="missing"):
        list(M._merge(2, 1)(("=a", 0), iter([("=a", 0, 0, 1, 2, "x")])))
