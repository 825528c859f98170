"""Operator 4: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight bytes. Two that differ in three bits at most share at least five bytes by position. Postings are
keyed by three positions and their byte values: the positions are two halves of four, and of any five positions three
lie in one half, so the eight triples within the halves reach every such pair. For the pairs of a posting the shared
positional bytes are tallied, pairs with the guaranteed minimum of five are retained, and those are verified bit by bit.

Postings hold distinct fingerprints only: exact copies, and texts of equal fingerprint, are one member. A posting longer
than HOT is split exactly: of the five other positions at least two agree, so its members are dealt out again to the
ten pairs of those; what is keyed so has 2^24 values at most, and longer lists among them are searched value by value
(all patterns of up to three flipped bits). A posting emits a spanning forest of its links, not all pairs: as many links
as members at most, with the same components. Components are joined over all postings by rounds of Spark joins.

Null and empty texts have fingerprint zero and link like any other. Rows with null ids take part; a component's id is
the smallest non-null doc_id in it. Repeated rows share their component. Extra columns are not read.

keep_one, a stage of the pipeline, links texts whose sets of five-word shingles have a Jaccard likeness of 0.8. SimHash
fingerprints of five-word shingles and the index above give the closest pairs. No radius of a fingerprint reaches every
pair as alike as that, so an inverted index of the shingles with count filtering adds the others: two such texts share
a known number of the rarest of their shingles. What both find is compared exactly, so no link rests on a fingerprint.
Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.batches import free_names, held, id_and_text, map_portions, portions
from pageflow.session import materialise, ship

BITS, SHARED_BYTES = 3, 5
#: A posting longer than this is dealt out by two more positions; a list longer than that, once more, is searched by flips.
HOT = 8192
#: Shingles whose bits are counted at once.
AT_ONCE = 200_000
#: keep_one: texts of a block and their shingles, texts of the sample that tells common shingles, and how many are told.
#: The sample is a part of the texts between bounds.
BLOCK, BLOCK_SHINGLES, TOLD, TOLD_MOST, TOLD_PART, COMMON = 512, 800_000, 8192, 200_000, 16, 400_000
#: Bytes of the texts of small components in one group, about.
GROUP_BYTES = 4_000_000
#: Pairs are listed for shingles of so many texts at most. Shingles of so many texts of the sample are long, and dealt to all tasks.
LIGHT, LONG, SALTED = 256, 3, 8
#: Texts of so many shingles about, and smaller ones, are found by two long shingles together.
SMALL = 64
#: Postings that a task holds before it deals them, postings of a bucket, pairs that a task holds before it counts them.
HELD, BUCKET, PAIRS = 600_000, 800_000, 1_000_000
#: Texts of a large group that all others of it are compared with first.
CENTRES = 64

TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def shingle_hashes(text: str | None, words_each: int, seed: int = 42) -> np.ndarray:
    """Hashes of all shingles in order, repeats included; a shorter text is one shingle, an empty one has none."""
    import xxhash

    words = text.encode().lower().split() if text else []  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < words_each:
        return np.array([digest(join(words), seed)], np.uint64)
    return np.fromiter((digest(join(s), seed) for s in zip(*(words[k:] for k in range(words_each)))), np.uint64, len(words) - words_each + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), AT_ONCE):
        part = hashes[start : start + AT_ONCE].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def simhash(text: str | None, words_each: int = 3, seed: int = 42) -> int:
    return fingerprint(shingle_hashes(text, words_each, seed))


def fingerprints(docs: DataFrame, words_each: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row."""
    ship(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held(("simhash",), object)  # caches of earlier stages go
        fps = np.array([simhash(t, words_each) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_portions(id_and_text(docs, id_col, text_col), run, "doc_id long, fp long")


class _Sets:
    """Disjoint sets over positions of an array; the smallest position is the root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[i] with b[i], all at once: labels fall along links until none changes."""
        p = self.parent
        while len(a):
            x, y = p[a], p[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(p, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(q := p[p], p):
                p[:] = q

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        return self.parent[child], child


def _verify(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter, then bits: pairs with five positional bytes in common and three differing bits at most."""
    x = a ^ b
    shared = np.zeros(x.shape, np.int8)
    for k in range(8):
        shared += (x >> np.uint64(8 * k) & np.uint64(255)) == 0
    out = shared >= SHARED_BYTES
    out[out] = np.bitwise_count(x[out]) <= BITS
    return out


def posting_links(fps: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints of one posting, compared block by block."""
    n, sets = len(fps), _Sets(len(fps))
    for i in range(0, n, block):
        for j in range(i, n, block):
            a, b = np.nonzero(_verify(fps[i : i + block, None], fps[None, j : j + block]))
            a, b = a + i, b + j
            keep = a < b
            sets.join(a[keep], b[keep])
    return sets.links()


def flip_links(fps: np.ndarray, same: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a long list of which the bytes in mask ``same`` agree: each member looks for its neighbours."""
    order = np.argsort(fps)
    ranked, sets = fps[order], _Sets(len(fps))
    free = [1 << b for b in range(64) if not same >> b & 1]
    for k in range(1, BITS + 1):
        for bits in combinations(free, k):
            near = ranked ^ np.uint64(sum(bits))
            at = np.minimum(np.searchsorted(ranked, near), len(ranked) - 1)
            hit = np.flatnonzero((ranked[at] == near) & (at > np.arange(len(ranked))))
            sets.join(hit, at[hit])
    a, b = sets.links()
    return order[a], order[b]


def _mask(positions: tuple[int, ...]) -> int:
    return sum(255 << 8 * p for p in positions)



def postings(nodes: DataFrame, sets_of_positions: list[tuple[int, ...]]) -> DataFrame:
    """fp, ps (which set of positions) and key (the bytes there, others zero) for each fingerprint and set."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*(F.struct(F.lit(i).alias("ps"), F.col("fp").bitwiseAND(F.lit(signed(_mask(p)))).alias("key")) for i, p in enumerate(sets_of_positions)))
    return nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.ps", "k.key")


def _search(sets_of_positions: list[tuple[int, ...]]):
    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        if len(fps) <= HOT:
            a, b = posting_links(fps)
        else:
            a, b = flip_links(fps, _mask(sets_of_positions[int(pdf["ps"].iloc[0])]))
        signed = fps.view(np.int64)
        return pd.DataFrame({"a": np.minimum(signed[a], signed[b]), "b": np.maximum(signed[a], signed[b])})

    return links


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that give all components; nodes: fp, distinct."""
    listed = postings(nodes, TRIPLES)
    sizes = listed.groupBy("ps", "key").agg(F.count("*").alias("n")).where("n > 1")
    hot = sizes.where(F.col("n") > HOT)
    plain = sizes.where(F.col("n") <= HOT)
    out = listed.join(plain, ["ps", "key"]).select("fp", "ps", "key").groupBy("ps", "key").applyInPandas(_search(TRIPLES), "a long, b long")
    fives = sorted({tuple(sorted(t + two)) for t in TRIPLES for two in combinations([p for p in range(8) if p not in t], 2)})
    members = listed.join(hot, ["ps", "key"]).select("fp").distinct()
    return out.unionByName(postings(members, fives).groupBy("ps", "key").applyInPandas(_search(fives), "a long, b long")).distinct()


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """fp and root (the smallest fp reachable), by alternating large-star and small-star rounds until nothing moves.

    Every round halves the depth at least; a round's links are written to the shared folder, so that no lineage grows.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "op4-links")
    before = None
    for _ in range(max_rounds):
        # large star: of u and its neighbours, link the larger ones to the smallest of all
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: link u and its smaller neighbours to the smallest of them
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "op4-links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(edges.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row."""
    rows = materialise(fingerprints(docs, id_col=id_col, text_col=text_col), "op4-fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "op4-nodes")
    found = components(nodes.select("fp"), links(nodes.select("fp")))
    named = found.join(nodes, "fp")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialise(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "op4-classes")
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- one row of each group of near copies, by exact likeness
def shingle_set(text: str | None, words_each: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    return np.unique(shingle_hashes(text, words_each))


def set_id(s: np.ndarray) -> int:
    """A hash of a set of shingles; 0 for the empty one."""
    import xxhash

    return xxhash.xxh64_intdigest(s.tobytes(), 42) if len(s) else 0


def _shared(n: int) -> int:
    """So many members of their prefixes, of the smaller set's count, two near copies of two or more shingles share at least."""
    return max(2, n // 25)


def _prefix_length(n: int, least: Fraction, shared: int | None = None) -> int:
    """Of their first so many members, in any common order, two sets as alike as ``least`` share so many (_shared) at least."""
    return min(n, n - ceil(least * n) + (_shared(n) if shared is None else shared))


def _level(size: np.ndarray | int, least: Fraction) -> np.ndarray:
    """The level of a set's size; with the next one, sizes of a near pair share one of their two levels."""
    return np.floor(np.log(size) / log(1.01 / least)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


#: Kinds of postings: shingles whose shared members are tallied; keys of long shingles, whose texts are all linked; the same, dealt to all tasks.
TALLIED, LINKED, DEALT = range(3)


class Told:
    """Shingles that several texts of a bounded sample have. What it tells changes orders and costs only: any table finds all pairs."""

    def __init__(self, hashes: np.ndarray, times: np.ndarray, share: float):
        """hashes: rarer first; times: texts of the sample that have them; share: the sample's part of all texts."""
        self.hashes, self.by = hashes, np.argsort(hashes)
        self.ranked, times = hashes[self.by], times[self.by]
        self.long, self.salted = times >= max(LONG, LIGHT * share), times >= max(SALTED, LIGHT * share)

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.ranked, h), max(0, len(self.ranked) - 1))
        return at, self.ranked[at] == h if len(self.ranked) else np.zeros(len(h), bool)

    def prefix(self, s: np.ndarray, k: int) -> np.ndarray:
        """The k rarest of a set: those not told, in order, then told ones."""
        at, known = self._places(s)
        rare = s[~known]
        return rare[:k] if len(rare) >= k else np.concatenate([rare, self.hashes[np.sort(self.by[at[known]])]])[:k]

    def postings(self, s: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray, int]:
        """Keys of a set's prefix, their kinds, and how many long shingles the prefix has.

        Two near copies share a member of their shortest prefixes, and _shared of those that are longer by as many. Where
        that is a long shingle, it is a key by itself, or for small sets together with any other member: such sets
        share two. Keys of long shingles hold a level of the size, so that only texts of like size are linked.
        """
        n = len(s)
        p = self.prefix(s, _prefix_length(n, least))
        at, known = self._places(p)
        long, salted = known.copy(), known.copy()
        long[known], salted[known] = self.long[at[known]], self.salted[at[known]]
        keys, kinds = [p[~long]], [np.full(int((~long).sum()), TALLIED, np.uint8)]
        if n > 1 and long.any():
            own, small, first = int(_level(n, least)), int(_level(SMALL, least)), _prefix_length(n, least, 1)
            i, j = np.triu_indices(len(p), 1)
            i, j = (x[long[i] | long[j]] for x in (i, j))
            alone = np.flatnonzero(long[:first])
            for level in (own, own + 1):
                if level <= small:
                    keys.append(_mix(_mix(p[i]) * np.uint64(3) ^ _mix(p[j]) + np.uint64(level)))
                    kinds.append(np.where(salted[i] & salted[j], DEALT, LINKED))
                else:
                    keys.append(_mix(p[alone] ^ _mix(np.uint64([level]))))
                    kinds.append(np.where(salted[alone], DEALT, LINKED))
        return np.concatenate(keys), np.concatenate(kinds).astype(np.uint8), int(long.sum())


def _told(texts: DataFrame, words_each: int) -> Told:
    n = texts.count()
    take = max(TOLD, min(TOLD_MOST, n // TOLD_PART))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words_each) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    some = texts.where(F.pmod(F.xxhash64("tk", F.lit("sample")), F.lit(1_000_000)) * n < take * 1_000_000).dropDuplicates(["tk"])
    counts = map_portions(some.select("text"), run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()[::-1]  # bounded
    return Told(np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["n"] for r in top], np.int64), min(1.0, take / max(n, 1)))


def _sketches(texts: DataFrame, words_each: int, least: Fraction) -> DataFrame:
    """doc_id, tk, sid (a hash of the text's set of shingles), fp (the set's fingerprint), size and the length of its prefix."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held(("simhash",), object)  # caches of earlier stages go
        sids, fps, sizes, prefixes = [], [], [], []
        for t in batch.column("text").to_pylist():
            s = shingle_set(t, words_each)
            sids.append(set_id(s))
            fps.append(fingerprint(s))
            sizes.append(len(s))
            prefixes.append(_prefix_length(len(s), least))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, fps)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), *longs, pa.array(sizes, pa.int32()), pa.array(prefixes, pa.int32())], ["doc_id", "tk", "sid", "fp", "size", "prefix"])

    return map_portions(texts, run, "doc_id long, tk long, sid long, fp long, size int, prefix int")


POSTINGS = {"h": "<u8", "sid": "<u8", "size": "<i4", "long": "<i4", "kind": "u1"}


def _postings(texts: DataFrame, words_each: int, least: Fraction, told: Told, buckets: int) -> DataFrame:
    """bucket and packed POSTINGS: a key, sid and size of a set that has it, its long shingles, the key's kind. Copies within a task are one."""

    def dealt(columns: list[np.ndarray]) -> pa.RecordBatch:
        h, sid, _, _, kind = columns
        bucket = (np.where(kind == DEALT, _mix(h ^ _mix(sid)), _mix(h)) % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket = bucket[by]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cut[1:].tolist(), len(h)]
        parts = [pa.array([x[a:b].tobytes() for a, b in zip(cut.tolist(), ends)], pa.binary()) for x in (c[by].astype(t) for c, t in zip(columns, POSTINGS.values()))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), *parts], ["bucket", *POSTINGS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(("simhash",), object)
        have: dict[int, tuple[np.ndarray, np.ndarray, int, int]] = {}
        n = 0

        def leave() -> pa.RecordBatch:
            keys, kinds, longs, sizes = zip(*have.values())
            each = lambda x, t: np.repeat(np.array(x, t), [len(k) for k in keys])
            out = dealt([np.concatenate(keys), each(list(have), np.uint64), each(sizes, np.int32), each(longs, np.int32), np.concatenate(kinds)])
            have.clear()
            return out

        for batch in batches:
            for part in portions(batch):
                for t in part.column("text").to_pylist():
                    s = shingle_set(t, words_each)
                    if len(s) and (sid := set_id(s)) not in have:
                        have[sid] = *told.postings(s, least), len(s)
                        n += len(have[sid][0])
                if n >= HELD:
                    yield leave()
                    n = 0
        if n:
            yield leave()

    return texts.select("text").mapInArrow(run, "bucket int, h binary, sid binary, size binary, long binary, kind binary")


LIST, STAR, CENTRE = range(3)
FOUND = "kind int, a long, b long, times int, sids array<long>, sizes array<int>, longs array<int>"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]
#: kind, a, b, and of lists how many keys have each and the members' sids, sizes and long shingles, a row a list.
Found = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _stars(group: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (sid, centre) of groups of rows, sorted by group and sid; the centre is a group's smallest."""
    head = np.r_[True, group[1:] != group[:-1]]
    centre = sid[np.flatnonzero(head)[np.cumsum(head) - 1]]
    edge = np.unique(np.stack([sid, centre], axis=1)[sid != centre], axis=0)
    return edge[:, 0], edge[:, 1]


def _joint_postings(h: np.ndarray, sid: np.ndarray, size: np.ndarray, long: np.ndarray, kind: np.ndarray, least: Fraction) -> Iterator[Found]:
    """Columns of FOUND from a bucket's postings: the different short lists, stars of others, and centres of keys dealt to all tasks."""
    by = np.lexsort((sid, h))
    h, sid, size, long, kind = (x[by] for x in (h, sid, size.astype(np.int64), long, kind))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    h, sid, size, long, kind = (x[new] for x in (h, sid, size, long, kind))
    start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    count = np.diff([*start, len(h)])
    tallied = kind[start] == TALLIED
    for m in range(2, LIGHT + 1):
        runs = start[(count == m) & tallied]
        if len(runs):
            at = runs[:, None] + np.arange(m)
            lists, first, times = np.unique(sid[at], axis=0, return_index=True, return_counts=True)
            at = at[first]
            yield LIST, lists[:, 0], lists[:, 1], times, lists, size[at], long[at]
    empty = lambda a: (np.zeros(len(a)), *(np.zeros((len(a), 0), np.uint64),) * 3)
    # tallied keys that have turned out long: texts of like size
    many = np.flatnonzero((count > LIGHT) & tallied)
    if len(many):
        at = np.concatenate([np.arange(start[i], start[i] + count[i]) for i in many])
        run, level = np.repeat(many, count[many]), _level(size[at], least)
        at, run, level = np.concatenate([at, at]), np.concatenate([run, run]), np.concatenate([level, level + 1])
        by = np.lexsort((sid[at], level, run))
        at, run, level = at[by], run[by], level[by]
        a, b = _stars(run * 1000 + level, sid[at])
        yield STAR, a, b, *empty(a)
    linked = kind != TALLIED
    if linked.any():
        a, b = _stars(h[linked], sid[linked])
        yield STAR, a, b, *empty(a)
    dealt = start[kind[start] == DEALT]
    if len(dealt):
        yield CENTRE, h[dealt], sid[dealt], *empty(dealt)


def _listed_pairs(batches: Iterator[pa.RecordBatch], least: Fraction) -> Iterator[tuple[np.ndarray, ...]]:
    """a, b, n, size and long of the pairs of like size of lists, counted over as many lists as give some PAIRS pairs."""
    p, q = least.numerator, least.denominator
    most = int(_level(SMALL, least))
    kept: list[tuple[np.ndarray, ...]] = []
    total = 0

    def counted() -> tuple[np.ndarray, ...]:
        a, b, n, z, w = (np.concatenate(x) for x in zip(*kept))
        by = np.lexsort((b, a))
        a, b, n, z, w = a[by], b[by], n[by], z[by], w[by]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        return a[first], b[first], np.add.reduceat(n, first), z[first], w[first]

    for batch in batches:
        times, offsets = batch.column("times").to_numpy(), batch.column("sids").offsets.to_numpy()
        flat = lambda c: batch.column(c).values.to_numpy()
        sid, size, long = flat("sids").view(np.uint64), flat("sizes").astype(np.int64), flat("longs")
        small = _level(np.maximum(size, 1), least) <= most
        count = np.diff(offsets)
        for m in np.unique(count).tolist():
            lists = np.flatnonzero(count == m)
            x, y = np.triu_indices(m, 1)
            step = max(1, PAIRS // len(x))
            for i in range(0, len(lists), step):
                some = lists[i : i + step]
                a, b = ((offsets[some][:, None] + v).ravel() for v in (x, y))
                n = np.repeat(times[some].astype(np.int64), len(x))
                fits = (size[a] * q >= size[b] * p) & (size[b] * q >= size[a] * p)
                a, b, n = a[fits], b[fits], n[fits]
                # two small sets meet by two keys at once, if long shingles are among them
                kept.append((sid[a], sid[b], n, np.minimum(size[a], size[b]), np.where(small[a] & small[b], 0, np.minimum(long[a], long[b]))))
                total += len(a)
                if total >= PAIRS:
                    yield counted()
                    kept, total = [], 0
    if total:
        yield counted()


def _may_be_near(texts: DataFrame, rows: DataFrame, words_each: int, least: Fraction) -> DataFrame:
    """Edges (a, b) between sets; every near pair lies within one component of these.

    Fingerprints give the closest pairs. Of the shingles, pairs are listed for those of few sets, filtered by size and
    by the tally of shared prefix members; shingles of the same sets are one list, and lists go by their smallest member. The sets of a long shingle (small sets: of two shingles) are linked to the
    smallest among those of like size, so no list grows by squares. Keys of very common shingles are dealt to all tasks,
    and their centres are linked in one more step.
    """
    told = _told(texts, words_each)
    total = rows.agg(F.coalesce(F.sum("prefix"), F.lit(0))).first()[0]
    buckets = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // BUCKET))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: dict[int, list[dict]] = {}
        for b in batches:
            for row in b.to_pylist():
                blobs.setdefault(row["bucket"], []).append(row)
        for rows_ in blobs.values():
            for kind, a, b, times, *members in _joint_postings(*(np.frombuffer(b"".join(r[k] for r in rows_), t) for k, t in POSTINGS.items()), least):
                n, m = members[0].shape
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * m)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.ravel())) for x in (members[0].view(np.int64), *(x.astype(np.int32) for x in members[1:]))]
                arrays = [pa.array(x) for x in (np.full(n, kind, np.int32), a.view(np.int64), b.view(np.int64), times.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*arrays, *lists], FOUND_NAMES)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, n, size, long in _listed_pairs(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int64), *(x.astype(np.int32) for x in (n, size, long)))], ["a", "b", "n", "size", "long"])

    found = materialise(_postings(texts, words_each, least, told, buckets).repartitionById(buckets, "bucket").mapInArrow(join, FOUND), "op4-found")
    # lists of one group of near copies mostly have one smallest member, so most of a pair's counts are added up in one task
    lists = found.where(F.col("kind") == LIST).select("a", "times", "sids", "sizes", "longs").repartition("a").sortWithinPartitions("a")
    pairs = lists.mapInArrow(tally, "a long, b long, n int, size int, long int")
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("size").alias("size"), F.min("long").alias("long"))
    pairs = pairs.where("n >= greatest(1, greatest(2, size div 25) - long)").select("a", "b")  # _shared, but for long ones
    stars = found.where(F.col("kind") == STAR).select("a", "b")
    centres = found.where(F.col("kind") == CENTRE).select(F.col("a").alias("h"), F.col("b").alias("a"))
    centres = centres.join(centres.groupBy("h").agg(F.min("a").alias("b")), "h").select("a", "b")
    prints = materialise(rows.groupBy("fp").agg(F.min("sid").alias("first")), "op4-prints")
    same = rows.join(prints, "fp").select(F.col("sid").alias("a"), F.col("first").alias("b"))
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_sid"))
    close = links(prints.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"))
    return pairs.union(stars).union(centres).union(same).union(close).where("a <> b").distinct()


def near_links(sets: list[np.ndarray], least: Fraction, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs whose Jaccard likeness is ``least`` or more; with side, of those across sides only."""
    n = len(sets)
    sizes, found = np.array([len(s) for s in sets]), _Sets(n)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(n), sizes), count[at] > 1
    column = (np.cumsum(count > 1) - 1)[at[shared]]
    owner = owner[shared]
    by = np.argsort(column, kind="stable")
    column, owner = column[by], owner[by]
    both, width = np.zeros((n, n), np.float32), 2048
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [start, start + width])
        x = np.zeros((n, min(width, int(column[-1]) + 1 - start)), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        both += x @ x.T
    p, q = least.numerator, least.denominator
    alike = both.astype(np.int64) * (p + q) >= p * (sizes[:, None] + sizes[None, :])
    a, b = np.nonzero(np.triu(alike, 1))
    if side is not None:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    found.join(a, b)
    return found.links()


def _compared(met: DataFrame, keys: list[str], words_each: int, least: Fraction) -> DataFrame:
    """Links (a, b) between the texts (sid, text, root, side) of each group; where side isn't null, across sides only."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": []}, dtype="int64")]
        for _, part in pdf.groupby("root"):
            side = None if part["side"].isna().all() else part["side"].to_numpy()
            sids = part["sid"].to_numpy(np.int64)
            a, b = near_links([shingle_set(t, words_each) for t in part["text"]], least, side)
            out.append(pd.DataFrame({"a": sids[a], "b": sids[b]}))
        return pd.concat(out)

    return met.groupBy(*keys).applyInPandas(search, "a long, b long").where("a <> b")


def _levels(least: Fraction) -> Column:
    """Both levels of a set's size (see _level)."""
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / float(log(1.01 / least))).cast("int")
    return F.array(level, level + 1)


def _blocks(n: Column, size: Column) -> Column:
    """In how many blocks so many texts with so many shingles are compared."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")


def _all_blocks(n: Column | str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _block(n: str, salt: str) -> Column:
    return F.pmod(F.xxhash64("sid", F.lit(salt)), F.col(n)).cast("int")


def _likeness_links(texts: DataFrame, rows: DataFrame, words_each: int, least: Fraction) -> DataFrame:
    """Links (a, b) between sets of shingles that give all components of pairs as alike as ``least``; none is left out.

    Components of pairs that may be near are compared whole if small. Of a large one, all texts meet some CENTRES of
    them first. The texts that this leaves outside the largest class then meet all of like size, block by block: pairs
    within the largest class need no look, so a large group of near copies is not compared pair by pair.
    """
    edges = materialise(_may_be_near(texts, rows, words_each, least), "op4-may")
    met = edges.select(F.col("a").alias("fp")).union(edges.select("b")).distinct()
    groups = components(met, edges).withColumnRenamed("fp", "sid")
    named = rows.groupBy("sid").agg(F.min("tk").alias("tk"), F.first("size").alias("size"))
    groups = materialise(groups.join(named, "sid"), "op4-groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"), _blocks(F.count("*"), F.sum("size")).alias("blocks"))
    members = groups.join(sizes, "root").join(texts.select("tk", "text").join(groups.select("tk"), "tk", "left_semi").groupBy("tk").agg(F.first("text").alias("text")), "tk")
    members = materialise(members.select("sid", "root", "size", "n", "blocks", "text", F.octet_length("text").alias("bytes")), "op4-members")
    # small components share a task's group as far as their number and their bytes allow
    small = members.where("blocks = 1").agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    members = members.drop("bytes")
    together = max(1, small[0] // BLOCK, -(-small[1] // GROUP_BYTES))
    whole = members.where("blocks = 1").select("sid", "text", "root", F.lit(None).cast("int").alias("side"), F.pmod(F.xxhash64("root"), F.lit(together)).alias("g"))
    out = [_compared(whole, ["g"], words_each, least)]
    large = members.where("blocks > 1")
    if not large.isEmpty():
        own = lambda side, *more: ("sid", "text", "root", F.lit(side).alias("side"), *more)
        centres = large.where(F.pmod(F.xxhash64("sid", F.lit("centre")), F.col("n")) < CENTRES)
        first = large.select(*own(0, _block("blocks", "block").alias("block"))).union(centres.select(*own(1, _all_blocks("blocks").alias("block"))))
        first = materialise(_compared(first, ["root", "block"], words_each, least), "op4-near")
        linked = first.select(F.col("a").alias("fp")).union(first.select("b")).distinct()
        classes = components(linked, first).select(F.col("fp").alias("sid"), F.col("root").alias("class"))
        classed = materialise(large.select("sid", "root").join(classes, "sid", "left").withColumn("class", F.coalesce("class", "sid")), "op4-classed")
        largest = classed.groupBy("root", "class").agg(F.count("*").alias("m")).groupBy("root").agg(F.max_by("class", F.struct("m", "class")).alias("largest"))
        outside = classed.join(largest, "root").where("class <> largest").select("sid")
        levelled = large.withColumn("level", F.explode(_levels(least)))
        asked = levelled.join(outside, "sid", "left_semi")
        of_level = lambda df, name: df.groupBy("root", "level").agg(_blocks(F.count("*"), F.sum("size")).alias(name))
        blocks = materialise(of_level(levelled, "blocks").join(of_level(asked, "asked"), ["root", "level"]), "op4-blocks")
        left = levelled.drop("blocks").join(blocks, ["root", "level"]).select(*own(0, "level", _block("blocks", "block").alias("block"), _all_blocks("asked").alias("by")))
        right = asked.drop("blocks").join(blocks, ["root", "level"]).select(*own(1, "level", _all_blocks("blocks").alias("block"), _block("asked", "asked").alias("by")))
        out += [first, _compared(left.union(right), ["root", "level", "block", "by"], words_each, least)]
    return reduce(DataFrame.union, out)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_each: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """One row of each group of near copies, with all its columns: of the smallest id, rows without an id last.

    Texts whose sets of ``words_each``-word shingles have a Jaccard likeness of ``least`` or more are linked, and links
    carry on. Of an id's rows in one group the one with the smallest hash of its text stays, of rows of equal id and
    text the first by their columns; rows of one id in different groups all stay, and so do different texts without an id.
    An empty table gives an empty one. Columns of any names are kept as they are.
    """
    ship(docs.sparkSession)
    texts = id_and_text(docs, id_col, text_col).withColumn("tk", F.xxhash64("text"))
    rows = materialise(_sketches(texts, words_each, least), "op4-sketches")
    links_ = materialise(_likeness_links(texts, rows, words_each, least), "op4-near")
    linked = links_.select(F.col("a").alias("fp")).union(links_.select("b")).distinct()
    classes = components(linked, links_).select(F.col("fp").alias("sid"), "root")
    each = rows.groupBy("doc_id", "tk").agg(F.first("sid").alias("sid"), F.count("*").alias("n"))
    each = each.join(classes, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    first = each.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tk", "n")).alias("w"))
    first = materialise(first.select(F.col("w.doc_id").alias("kept_id"), F.col("w.tk").alias("kept_text"), F.col("w.n").alias("kept_n")), "op4-first")
    own_id, own_text = free_names(docs, "own_id", "own_text")
    keyed = docs.withColumns({own_id: F.col(id_col).cast("long"), own_text: F.xxhash64(F.col(text_col).cast("string"))})

    def those(chosen: DataFrame) -> DataFrame:
        return keyed.join(chosen, (keyed[own_text] == chosen["kept_text"]) & keyed[own_id].eqNullSafe(chosen["kept_id"]), "left_semi")

    row = F.struct(*docs.columns)
    repeated = those(first.where("kept_n > 1")).groupBy(own_id, own_text).agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
    return those(first.where("kept_n = 1")).select(*docs.columns).unionByName(repeated)
