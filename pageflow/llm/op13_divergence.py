"""Operator 13: how far the sources of a language are apart in their words.

Terms are runs of letters; a language keeps those that occur in MIN_DOCS of its documents. Every group (language and
source) and every language gives each kept term a smoothed share in whole billionths. Two groups differ by the sum of the
differences of their shares; a group's marked terms are those whose share most exceeds the language's.

Tasks count the terms of their rows by group; one shuffle by language and term adds the counts and drops rare terms. A
language's terms are dealt to blocks by a hash. A block becomes a matrix of its groups by its terms (numpy, int64), zeros
included; the differences of all pairs of rows are taken by broadcasting some rows at a time against all later ones,
and every group's greatest excesses are kept. The partial sums of pairs are added, the partial lists merged.

Null texts, languages and sources are empty ones, and groups like any other. Groups without terms take part: they have the
share of a count of 0. A language that keeps no term has pairs of value 0 and no marked terms; a language of one source has
no pairs. Repeated rows and ids are documents of their own. An empty table gives an empty result. Extra columns are
not read. All arithmetic is exact up to 9 * 10^15 occurrences. Memory of a task: COUNTED bytes of text or ENTRIES terms while it
counts, then a block's matrix of about CELLS numbers (64 terms of all groups at least).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.batches import batches_of, in_order
from pageflow.session import materialise, ship

#: Documents of a language that a kept term occurs in; marked terms of a group.
MIN_DOCS, TOP = 30, 50
#: Terms of a block at most; numbers of a block's matrix, and of one broadcast.
TERMS, CELLS = 1024, 1 << 20
#: What a task counts before it hands its counts on: different terms, bytes of text.
ENTRIES, COUNTED = 300_000, 64_000_000

# Bytes that are no part of a term are separators, and A to Z are lower-cased.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


COUNTS = "lang string, source string, term binary, n long, docs long"


def count_terms(docs: DataFrame) -> DataFrame:
    """COUNTS of each task's rows (lang, source, text, no nulls); an empty term with n 0 stands for the group itself."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        entries = size = 0

        def leave() -> Iterator[tuple]:
            for (lang, source), (n, df) in held.items():
                yield lang, source, b"", 0, 0
                for term, k in n.items():
                    yield lang, source, term, k, df[term]
            held.clear()

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                n, df = held[lang, source]
                before = len(n)
                terms = terms_of(text.as_buffer().to_pybytes())
                n.update(terms)
                df.update(set(terms))
                entries, size = entries + len(n) - before, size + len(text.as_buffer())
                if entries > ENTRIES or size > COUNTED:
                    yield from leave()
                    entries = size = 0
        yield from leave()

    return docs.mapInArrow(lambda batches: batches_of(count(batches), COUNTS), COUNTS)


def shares(counts: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), by long division: no step exceeds 64 bits."""
    whole = total + 5 * terms
    out, rest = np.divmod(counts + 5, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


PARTS = "lang string, part string, source string, item string, value long"


def _block(top: int) -> object:
    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Partial pairs (each once, the smaller name first) and the greatest excesses of a block."""
        lang = key[0]
        names: list[str] = []
        totals, vocabulary = [], 0
        at: dict[str, int] = {}
        terms: list[bytes] = []
        cells: tuple[list, list, list] = ([], [], [])
        for _, _, kind, term, source, n, v in rows:  # heads by source, then cells by term
            if kind == 0:
                at[source] = len(names)
                names.append(source)
                totals.append(n)
                vocabulary = v
                continue
            if not terms or terms[-1] != term:
                terms.append(term)
            for out, x in zip(cells, (at[source], len(terms) - 1, n)):
                out.append(x)
        counts = np.zeros((len(names), len(terms)), np.int64)
        if terms:
            counts[cells[0], cells[1]] = cells[2]
        total = np.array(totals, np.int64)
        p = shares(counts, total[:, None], vocabulary) if terms else counts
        # all pairs, some rows at a time against all later ones
        step = max(1, CELLS // max(1, counts.size))
        for a in range(0, len(names) - 1, step):
            some = p[a : a + step]
            apart = np.abs(some[:, None, :] - p[None, a + 1 :, :]).sum(axis=2)
            for i, line in enumerate(apart.tolist(), a):
                for j in range(i + 1, len(names)):
                    yield lang, "pair", names[i], names[j], line[j - a - 1]
        if not terms:
            return
        q = shares(counts.sum(axis=0), total.sum(), vocabulary)
        excess = np.where((counts > 0) & (p > q), p - q, 0)
        for name, line in zip(names, excess):
            best = np.argsort(-line, kind="stable")[:top]  # ties: terms ascend
            for k in best[line[best] > 0].tolist():
                yield lang, "term", name, terms[k].decode(), int(line[k])

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the distances of a group's pairs, and its marked terms up to ``top``."""
    ship(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
    # one shuffle: the counts of a term of a language meet
    added = count_terms(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    known = added.withColumns({"all_docs": F.sum("docs").over(of_term), "first": F.row_number().over(of_term.orderBy("source")) == 1})
    is_group = F.octet_length("term") == 0
    kept = materialise(known.where(is_group | (F.col("all_docs") >= min_docs)).select("lang", "source", "term", "n", (F.col("first") & ~is_group).alias("first")), "divergence-terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if("first").alias("v"), F.count_if(is_group).alias("groups"))
    langs = langs.select("lang", "v", F.expr(f"cast(greatest(1, ceil(v / least({TERMS}, greatest(64, {CELLS} div groups)))) as int)").alias("blocks"))
    heads = groups.join(langs, "lang").select("lang", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.lit(0).alias("kind"), F.lit(b"").alias("term"), "source", "n", "v")
    cells = kept.where(~is_group).join(langs, "lang").select("lang", F.expr("cast(pmod(xxhash64(term), blocks) as int)").alias("block"), F.lit(1).alias("kind"), "term", "source", "n", "v")
    dealt = heads.union(cells).repartition("lang", "block").sortWithinPartitions("lang", "block", "kind", "term", "source")
    parts = materialise(in_order(dealt, 2, _block(top), PARTS), "divergence-parts")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by).alias("rank"))
    marked = out(parts.where("part = 'term'"), "term").where(F.col("rank") <= top)
    return out(both.select("lang", "x.source", "x.item", "value"), "pair").union(marked)


ORACLE = f"""with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
words as (select id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from docs),
kept as (select lang, term from words group by lang, term having count(distinct id) >= {MIN_DOCS}),
sizes as (select lang, (select count(*) from kept k where k.lang = d.lang) as v from (select distinct lang from docs) d),
groups as (select distinct lang, source from docs),
cells as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from groups g join kept k using (lang) left join (select lang, source, term, count(*) as n from words group by all) c using (lang, source, term)),
shares as (select lang, source, term, n, (1 + 1000000000::hugeint * (n + 5) // (sum(n) over (partition by lang, source) + 5 * v))::bigint as p,
  (1 + 1000000000::hugeint * (sum(n) over (partition by lang, term) + 5) // (sum(n) over (partition by lang) + 5 * v))::bigint as q from cells join sizes using (lang)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
ranked as (select lang, source, 'pair' as part, item, value from (select a.lang, a.source, b.source as item, coalesce(p.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source)
  union all select lang, source, 'term', term, p - q from shares where n > 0 and p > q)
select * from (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from ranked) where part = 'pair' or rank <= {TOP}"""
