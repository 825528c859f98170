"""Operator 13 against counts by hand, and its long division against Python's integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageflow.llm import op13_divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def by_hand(rows, min_docs, top):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        terms = TERM.findall((r["text"] or "").translate(lower))
        counts[r["lang"] or "", r["source"] or ""].update(terms)
        seen[r["lang"] or ""].update(set(terms))
    out = []
    for lang in seen:
        kept = [t for t, n in seen[lang].items() if n >= min_docs]
        groups = sorted(s for x, s in counts if x == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in groups}
        share = lambda n, of: 1 + 10**9 * (n + 5) // (of + 5 * len(kept))
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in groups}
        q = {t: share(sum(counts[lang, s][t] for s in groups), sum(total.values())) for t in kept}
        for s in groups:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("terms,cells,entries", [(1024, 1 << 20, 300_000), (64, 700, 40)])
def test_a_table(spark, sample, monkeypatch, terms, cells, entries):
    for name, x in (("TERMS", terms), ("CELLS", cells), ("ENTRIES", entries)):
        monkeypatch.setattr(D, name, x)
    assert got(D.divergence(sample, 5, 7)) == by_hand(sample.collect(), 5, 7)


def test_odd_rows(spark, docs):
    """Nulls, a group without terms, a language of one source, names in other scripts, clashing columns, a NUL in a text."""
    lang = F.when(F.col("doc_id").isNull(), None).when(F.col("doc_id") == 7, "").when(F.col("doc_id") == 3, "ひ").otherwise(F.col("lang"))
    source = F.when(F.col("doc_id") == 5, None).when(F.col("doc_id") == 2, "empty").when(F.col("doc_id") == 8, "é").otherwise(F.col("source"))
    rows = docs.select("*", F.lit(1).alias("term"), F.lit(2).alias("n")).withColumns({"lang": lang, "source": source})
    for least in (1, 2, 100):
        assert got(D.divergence(rows, least, 3)) == by_hand(rows.collect(), least, 3)


def test_empty(none):
    assert D.divergence(none).collect() == []


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for size in (10, 10**6, 10**12, 9 * 10**15):
        total = int(size)
        counts = np.array([0, 1, total // 3, total, *rng.integers(0, total + 1, 20).tolist()])
        for terms in (1, 7, 100_003):
            assert D.shares(counts, np.int64(total), terms).tolist() == [1 + 10**9 * (int(n) + 5) // (total + 5 * terms) for n in counts]


def test_terms_are_those_of_the_pattern():
    text = "Abc DéF_g\x00h 1x@y[z]`{}~\x7f ÄÖ－ａ İi"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
    assert [t.decode() for t in D.terms_of(text.encode())] == TERM.findall(text.translate(lower))
