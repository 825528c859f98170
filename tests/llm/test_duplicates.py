from fractions import Fraction
import random
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from pageflow.llm import op4_simhash, op10_digest


def reference_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(sorted(parent), np.uint64)
    for a, b in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)):
        a, b = find(int(u[a])), find(int(u[b]))
        parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in parent}


def clusters(n, seed):
    """Random fingerprints, chains of near ones and a dense ball."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(20):
        f = rng.getrandbits(64)
        for _ in range(15):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                f ^= 1 << b
            out.add(f)
    centre = rng.getrandbits(64)
    out |= {centre ^ (1 << a | 1 << b) for a in range(64) for b in range(0, 64, 5)}
    return sorted(out)


def component_classes(spark, fps):
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = op4_simhash.components(nodes, op4_simhash.links(nodes)).collect()
    classes = {}
    for r in found:
        classes.setdefault(r["root"], set()).add(r["fp"] % (1 << 64))
    return sorted(map(sorted, classes.values()))


def expected_classes(fps):
    classes = {}
    for f, root in reference_components(fps).items():
        classes.setdefault(root, set()).add(f)
    return sorted(map(sorted, classes.values()))


def test_components_equal_brute_force(spark):
    fps = clusters(300, 1)
    assert component_classes(spark, fps) == expected_classes(fps)


def test_hot_postings_are_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "HOT", 40)
    fps = clusters(50, 2)
    assert component_classes(spark, fps) == expected_classes(fps)


def test_posting_searches_agree():
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 24, 600, dtype=np.uint64) & np.uint64(0xF3F))
    a, b = op4_simhash.posting_links(fps)
    c, d = op4_simhash.flip_links(fps, ((1 << 64) - 1) ^ 0xFFFFFF)

    def classes(x, y):
        s = op4_simhash._Sets(len(fps))
        s.join(np.minimum(x, y), np.maximum(x, y))
        return s.parent.tolist()

    assert classes(a, b) == classes(c, d)


def test_near_duplicates(docs, none):
    got = op4_simhash.near_duplicates(docs).toPandas()
    assert len(got) == len(TEXTS)  # noqa: F405
    by = {i: c for i, c in zip(got["doc_id"], got["component_id"]) if i == i}
    assert by[8] == 0 and by[0] == 0 and by[2] == by[4] == 1 == by[1] and by[5] == 5
    assert got.loc[got["doc_id"] == 2, "fingerprint"].iloc[0] == "0" * 16
    assert op4_simhash.near_duplicates(none).count() == 0
    kept = op4_simhash.keep_one(docs)
    assert kept.columns == docs.columns
    # the text without an id is alone in its component, which has no id to keep
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is not None, x or 0)) == [None, 0, 1, 3, 5, 6, 7, 9]


def test_fingerprint_by_hand():
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ("a b c", "b c d", "c d e")]
    want = sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > 3)
    assert op4_simhash.simhash("A b\tC \n d\x0be") == want
    assert op4_simhash.simhash("É x") == xxhash.xxh64_intdigest("É x".encode(), 42)


def canonical(t):
    folded = unicodedata.normalize("NFC", t or "").upper().lower().replace("ς", "σ")
    return re.sub("[\\s\x1c-\x1f\x85\ufeff]+", " ", folded).strip(" ")


def test_normal_form(spark):
    rng = random.Random(5)
    signs = list("aAeE oỌ̧́̀̈̊ͅßÅΩ각가각Σς\t\n 　﻿🙂ொཱུ̈́éệ̸=İı")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in op10_digest.with_canonical(df.withColumn("n", op10_digest.nfc(F.col("text"))), "text", "c").collect():
        assert r["n"] == unicodedata.normalize("NFC", r["text"])
        assert r["c"] == canonical(r["text"])


def expect_edits(rows):
    """(id, n, edited text, canonical forms of the text, the edited and the next one) of rows in order."""
    out = []
    for k, (i, t) in enumerate(rows):
        nxt, q = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        out.append((i, len(t), edited, canonical(t), canonical(edited), canonical(nxt)))
    return out


def check_edits(table):
    import hashlib

    rows = [(r["doc_id"], r["text"] or "") for r in table.select("doc_id", "text").collect()]
    forms = op10_digest.with_canonical(table.select(F.coalesce("text", F.lit("")).alias("text")).distinct(), "text", "form")
    hashes = {r["text"]: r["h"] for r in forms.select("text", op10_digest.wide_hash(F.col("form")).alias("h")).collect()}
    # rows of one id are ordered by their hashes
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]], r[1].encode()))
    want = sorted(expect_edits(rows), key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[2].encode()).hexdigest(), x[3]))
    result = op10_digest.fingerprint_edits(table).collect()
    prints, own, got = {}, {}, {}
    for r in result:
        got.setdefault((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]), []).append(r)
    for i, n, edited, a, b, c in want:
        r = got[i, n, hashlib.sha256(edited.encode()).hexdigest(), float(a == b), float(a == c)].pop()
        own.setdefault(a, set()).add(r["fingerprint"])
        prints.setdefault(b, set()).add(r["edited_fingerprint"])
    assert not any(got.values())
    assert all(len(own.get(f, set()) | prints.get(f, set())) == 1 for f in {*own, *prints})
    assert len({x for xs in own.values() for x in xs}) == len(own)


def test_edits_of_rows_with_one_id(spark):
    """A third of the rows without an id and a third with one id: their ranges are cut by the hash."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(8))) for i in [None] * 40 + [7] * 40 + list(range(-5, 35))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = table.withColumn("hash", F.lower(F.hex(F.xxhash64("text"))))
    ranged, n = op10_digest.with_range(keyed, 12)
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}
    assert max(sizes) < n and max(sizes.values()) <= 30
    check_edits(table)


def test_edits(spark, docs, none, sample):
    check_edits(docs)
    check_edits(sample)
    assert op10_digest.fingerprint_edits(none).count() == 0
    one = spark.createDataFrame([(3, "just one")], "doc_id long, text string")
    assert op10_digest.fingerprint_edits(one).first()["near_next"] == 1.0


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(op10_digest, "wide_hash", lambda form: F.lpad((F.length(form) % 3).cast("string"), 32, "0"))
    check_edits(spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "AA", "bb", "cccc", "cc", "dddd", "", "aa "])], "doc_id long, text string"))


def test_canonical_texts_with_one_fingerprint_are_told_apart(spark, monkeypatch):
    """Every xxhash is weak here, so canonical texts of one length share both halves of the fingerprint; the key is the code's own."""
    monkeypatch.setattr(op10_digest.F, "xxhash64", lambda *cols: F.length(cols[-1] if not isinstance(cols[-1], str) else F.col(cols[-1])).cast("long"))
    texts = ["abc", "abd", "abc", "xyz", "ab", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_edits(rows)
    got = {r["doc_id"]: r["fingerprint"] for r in op10_digest.fingerprint_edits(rows).collect()}
    assert len({got[i] for i in (0, 1, 3)}) == 3 and got[0] == got[2] and got[5] == got[6]
    assert {got[i][:32] for i in (0, 1, 3)} == {got[0][:32]}


def edited(words, rng, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def likeness_classes(texts):
    """Components of all pairs with a five-word Jaccard likeness of 0.8, by brute force."""
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("salted", [3, 10**9])
def test_keep_one_finds_every_near_copy(spark, monkeypatch, salted):
    for name, value in {"BLOCK": 8, "LIGHT": 20, "TOLD": 100, "CENTRES": 2, "SALTED": salted}.items():
        monkeypatch.setattr(op4_simhash, name, value)
    rng = random.Random(6)
    line, texts = [f"line{i}" for i in range(12)], []
    for n in (3, 6, 30, 100, 300):
        for _ in range(6):
            base = [f"w{rng.randrange(3000)}" for _ in range(n)]
            texts += [" ".join(base + line)] + [" ".join(edited(base, rng, s) + line) for s in (0.01, 0.02, 0.03, 0.04, 0.05)]
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    texts += [" ".join(edited(base, rng, 0.02)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(set(likeness_classes(texts)))
    assert len(texts) / 4 < len(want) < len(texts)
    assert sorted(r["doc_id"] for r in op4_simhash.keep_one(docs).collect()) == want


def test_keep_one_leaves_columns_of_any_name_alone(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(1, text, 11, "a", "k", 5), (2, text + " end", 12, "b", "l", 6), (3, None, 13, "c", "m", 7), (4, None, 14, "d", "n", 8), (5, "", 15, "e", "o", 9), (1, text, 10, "a", "k", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id int, __tk string, Own_ID string, kept_n int")
    got = sorted(tuple(r) for r in op4_simhash.keep_one(docs).collect())
    assert got[0] == (1, text, 10, "a", "k", 5) and all(r in rows for r in got)
    assert {r[0] for r in got} >= {1, 3} and 2 not in {r[0] for r in got}
    assert op4_simhash.keep_one(docs.limit(0)).columns == docs.columns and op4_simhash.keep_one(docs.limit(0)).collect() == []


def test_keep_one_with_repeated_and_missing_ids(spark):
    texts = [" ".join(f"{k}x{i}" for i in range(60)) for k in "abcdef"]
    near = texts[0] + " end"
    rows = [(None, texts[0]), (None, near), (None, texts[1]), (None, texts[1]), (None, texts[2]), (4, texts[2]), (7, texts[3]), (7, texts[4]), (8, texts[5]), (8, texts[5])]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    got = sorted((r["doc_id"] or -1, r["n"]) for r in op4_simhash.keep_one(docs).collect())
    assert [g for g in got if g[0] > 0] == [(4, 5), (7, 6), (7, 7), (8, 8)]
    none = [n for i, n in got if i < 0]
    assert len(none) == 2 and none[0] in (0, 1) and none[1] == 2


def test_shared_shingles_give_few_rows_a_pair():
    """A pair's rows don't grow with the buckets that its shared shingles are dealt to: lists of one smallest member meet again."""
    import pyarrow as pa

    from pageflow.llm import op4_simhash as O

    rng, least, rows, want = np.random.default_rng(5), Fraction(4, 5), [], {}
    for sids in rng.integers(1, 2**60, (40, 5)).astype(np.uint64):
        sids.sort()
        for _ in range(30):  # keys of a group of near copies: all of it, or without one member
            have = np.delete(sids, rng.integers(0, 5)) if rng.random() < 0.3 else sids
            rows.append((rng.integers(0, 2**60), have))
            for i, a in enumerate(have.tolist()):
                for b in have.tolist()[i + 1 :]:
                    want[a, b] = want.get((a, b), 0) + 1
    lists = []
    for bucket in range(64):
        some = [(h, s) for h, s in rows if h % 64 == bucket]
        if some:
            sid = np.concatenate([s for _, s in some])
            h = np.repeat(np.array([h for h, _ in some], np.uint64), [len(s) for _, s in some])
            full = lambda x, t: np.full(len(sid), x, t)
            for kind, a, b, times, sids, sizes, longs in O._joint_postings(h, sid, full(100, np.int32), full(0, np.int32), full(O.TALLIED, np.uint8), least):
                assert kind == O.LIST
                lists += zip(a.tolist(), times.tolist(), sids.view(np.int64).tolist(), sizes.tolist(), longs.tolist())
    lists.sort()
    names, kinds = ["times", "sids", "sizes", "longs"], [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
    batch = pa.RecordBatch.from_arrays([pa.array([x[i + 1] for x in lists], k) for i, k in enumerate(kinds)], names)
    got, pairs = {}, 0
    for a, b, n, _, _ in O._listed_pairs(iter([batch.slice(0, 100), batch.slice(100)]), least):
        pairs += len(a)
        for x, y, m in zip(a.tolist(), b.tolist(), n.tolist()):
            got[x, y] = got.get((x, y), 0) + m
    assert got == want
    assert pairs <= 1.1 * len(want)
