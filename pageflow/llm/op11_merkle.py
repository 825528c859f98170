"""Operator 11: a Merkle manifest of a dataset.

Every row is a leaf: the digest of its fields. Leaves of a group stand in the order of their ids; runs of ``fanout`` nodes are
hashed to their parent, level by level, a shorter last run as it is (no padding). The groups' roots are the leaves of one more
tree, in the order of the groups' names, null first. A digest is SHA-256 in lowercase hex, of the parts' hex text.

Rows are dealt to ranges of group and id. The counts of the ranges before give each range the index of its first leaf, and
its rows run through a mountain-range stack: a leaf is pushed, and while the newest run of a level is full it is carried to the
level above. What is formed is a node record; what is left when the range ends, and at its left edge what belongs to a run
that began before, are peaks, 2 * fanout * height at most. Peaks are merged in rounds: those under one node of a level meet,
are completed there, short last runs included, and one peak is left of them for the next round, STEP levels higher. So
no task sees more than the peaks of some 2^STEP ranges.

A proof is read from the node records: leaves are dealt to aligned blocks with the records below the block's node; the siblings
from there up are looked up once for a block. Verification folds each leaf with its siblings to the root.

Null fields are hashed as ``-``. Null ids come first in their group; rows of one id stand in the order of their digests, so
repeated rows are leaves of equal digests. A null group is a group of its own, the first. A group of one row is its leaf.
An empty table gives an empty manifest: no nodes, no root. Extra columns are not read. Memory of a task: a stack, or a block of
BLOCK leaves and its records.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.batches import in_order
from pageflow.session import materialise, ship

#: Children of a node; leaves of an aligned block, about; levels of a merging round; rows of a range, about.
FANOUT, BLOCK, STEP, RANGE_ROWS = 2, 1 << 12, 6, 1 << 19
#: Levels that a tree of 2^62 leaves has at most.
LEVELS = 62

#: Records of a tree: level 0 are leaves, with what they carry. n is the number of the group's leaves.
NODE = "grp string, level int, idx long, n long, hash string, num long, txt string, extra string, formed boolean, peak boolean"


# --- digests
def field(value: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def joined_digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def group_key(group: Column) -> Column:
    """A name without nulls, in the order of the groups."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- the tree
@dataclass
class Tree:
    """nodes: records of NODE, every node once. roots: grp, level, n, hash of each group's root. height: of the highest group."""

    nodes: DataFrame
    roots: DataFrame
    height: int
    fanout: int


def height_of(n: int, fanout: int) -> int:
    level, width = 0, 1
    while width < n:
        level, width = level + 1, width * fanout
    return level


def _stack(fanout: int) -> Callable:
    """The nodes of a range's leaves of one group; the range's first row tells the index of its first leaf."""

    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        grp = key[1]
        _, _, _, at, n, *_ = next(rows)
        pending: list[list[str]] = []  # of each level, the newest nodes that have no parent yet
        for _, _, _, _, _, num, txt, leaf, extra in rows:
            level, idx, h, carried = 0, at, leaf, (num, txt, extra)
            while True:
                if level == len(pending):
                    pending.append([])
                run_ = pending[level]
                run_.append(h)
                full = (idx + 1) % fanout == 0
                if not full or len(run_) < fanout:
                    if full:  # the run began in the range before
                        yield from _as_peaks(grp, level, idx, n, run_)
                        pending[level] = []
                    # the record itself; peaks are told again when they are known to be ones
                    yield grp, level, idx, n, h, *carried, True, False
                    break
                yield grp, level, idx, n, h, *carried, True, False
                pending[level] = []
                level, idx, h, carried = level + 1, idx // fanout, joined_digest(run_), (None, None, None)
            at += 1
        width = 1
        for level, run_ in enumerate(pending):
            if run_:
                yield from _as_peaks(grp, level, at // width - 1, n, run_)
            width *= fanout

    return run


def _as_peaks(grp: str, level: int, last: int, n: int, hashes: list[str]) -> Iterator[tuple]:
    for k, h in enumerate(hashes):
        yield grp, level, last - len(hashes) + 1 + k, n, h, None, None, None, False, True


def _merge(fanout: int, top: int) -> Callable:
    """What the peaks under one node of level ``top`` form; the highest is the next round's peak."""

    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        grp, levels, n = key[0], {}, 0
        for _, _, level, idx, n, h in rows:
            levels.setdefault(level, {})[idx] = h
        end = min(top, height_of(n, fanout))
        width = n  # nodes of the level
        for level in range(end):
            above = levels.setdefault(level + 1, {})
            parents: dict[int, list[int]] = {}
            for idx in sorted(levels.pop(level, {}).items()):
                parents.setdefault(idx[0] // fanout, []).append(idx)
            for p, kids in parents.items():
                if len(kids) != min(fanout, width - p * fanout):
                    raise ValueError(f"nodes are missing under node {p} of level {level + 1} in group {grp!r}")
                above[p] = joined_digest(h for _, h in kids)
                yield grp, level + 1, p, n, above[p], None, None, None, True, False
            width = -(-width // fanout)
        for idx, h in levels[end].items():
            yield grp, end, idx, n, h, None, None, None, False, True

    return run


def _divided(value: str, width: str) -> Column:
    return F.expr(f"{value} div {width}")


def build(rows: DataFrame, fanout: int = FANOUT) -> Tree:
    """The trees of all groups. rows: grp (no null), num, txt, hash, extra; leaves of a group are ordered by num, txt, hash."""
    spark = rows.sparkSession
    ship(spark)
    rows = materialise(rows.select("grp", "num", "txt", "hash", "extra"), "merkle-leaves")
    total = rows.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 64), -(-total // RANGE_ROWS))
    # equal rows are equal leaves: any number may part them
    ranged = rows.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(parts, "grp", "num", "txt", "hash", "_any").drop("_any")
    ranged = materialise(ranged.withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("part", "grp").agg(F.count("*").alias("here"))
    by = Window.partitionBy("grp").orderBy("part")
    counts = materialise(counts.select("part", "grp", "here", F.coalesce(F.sum("here").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("here").over(Window.partitionBy("grp")).alias("n")), "merkle-counts")
    most = counts.agg(F.max("n"), F.max("here")).first()
    height, low = height_of(most[0] or 0, fanout), height_of(most[1] or 0, fanout)
    heads = counts.select("part", "grp", F.lit(0).alias("kind"), F.col("before").alias("at"), "n", *(F.lit(None).cast(t).alias(c) for c, t in (("num", "long"), ("txt", "string"), ("hash", "string"), ("extra", "string"))))
    leaves = ranged.select("part", "grp", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("n"), "num", "txt", "hash", "extra")
    dealt = heads.union(leaves).repartitionById(parts, "part").sortWithinPartitions("part", "grp", "kind", "num", "txt", "hash")
    first = materialise(in_order(dealt, 2, _stack(fanout), NODE), "merkle-nodes")
    formed, peaks, top = [first.where("formed")], first.where("peak"), min(low + STEP, height)
    while True:
        under = peaks.select("grp", F.expr(f"idx div cast(pow({fanout}, {top} - level) as long)").alias("block"), "level", "idx", "n", "hash")
        met = under.repartition("grp", "block").sortWithinPartitions("grp", "block", "level", "idx")
        found = materialise(in_order(met, 2, _merge(fanout, top), NODE), "merkle-merged")
        formed.append(found.where("formed"))
        peaks = found.where("peak")
        if top >= height:
            break
        top = min(top + STEP, height)
    return Tree(reduce(DataFrame.union, formed).drop("formed", "peak"), peaks.select("grp", "level", "n", "hash"), height, fanout)


# --- proofs
PROVEN = "grp string, num long, txt string, hash string, proof string, folded string, path string"


def _fold(leaf: str, sides: Iterable[tuple[str, str]]) -> str:
    for left, right in sides:
        leaf = hashlib.sha256((left + leaf + right).encode()).hexdigest()
    return leaf


def _prove(fanout: int, low: int, paths: bool) -> Callable:
    """Of each leaf of a block, its siblings' digest and the root that its changed (else own) digest folds to."""

    def run(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        grp, block = key
        head = next(rows)
        n, upper = head[5], [tuple(x.split("|")) for x in head[9].split(",") if x]
        levels: list[dict[int, str]] = [{} for _ in range(low + 1)]
        leaves = []
        for _, _, _, level, idx, _, h, num, txt, extra in rows:
            levels[level][idx] = h
            if level == 0:
                leaves.append((idx, num, txt, h, extra))
        own = min(low, height_of(n, fanout))  # levels whose siblings lie in the block
        for idx, num, txt, h, changed in leaves:
            sides, at = [], idx
            for level in range(own):
                start, nodes = at - at % fanout, levels[level]
                around = [nodes.get(j, "") for j in range(start, start + fanout)]
                sides.append(("".join(around[: at - start]), "".join(around[at - start + 1 :])))
                at //= fanout
            sides += upper
            proof = joined_digest(x for side in sides for x in side)
            yield grp, num, txt, h, proof, _fold(changed or h, sides), ",".join(map("|".join, sides)) if paths else None

    return run


def prove(tree: Tree, beyond: DataFrame | None = None, paths: bool = False) -> DataFrame:
    """PROVEN of every leaf. beyond: grp and path, what follows a group's root on the way to a root above it.

    A path is text: levels joined by commas, each the digests on the left, a bar, and those on the right.
    """
    f, low = tree.fanout, max(1, height_of(BLOCK + 1, tree.fanout) - 1)
    wide = f"cast({f ** low} as long)"
    leaves = tree.nodes.where("level = 0")
    heads = leaves.where(f"idx % {wide} = 0").select("grp", "n", _divided("idx", wide).alias("block"))
    # siblings of the block's node and of all above it
    widths = F.array(*(F.lit(f**k) for k in range(LEVELS) if f**k < 1 << LEVELS))
    steps = heads.withColumn("height", F.size(F.filter(widths, lambda w: w < F.col("n")))).where(f"height > {low}")
    steps = steps.withColumn("level", F.explode(F.expr(f"sequence({low}, height - 1)")))
    steps = steps.selectExpr("grp", "block", "level", f"block div cast(pow({f}, level - {low}) as long) as own", f"(n + cast(pow({f}, level) as long) - 1) div cast(pow({f}, level) as long) as width")
    asked = steps.withColumn("idx", F.explode(F.expr(f"sequence(own - own % {f}, least(own - own % {f} + {f - 1}, width - 1))")))
    upper_nodes = tree.nodes.where(f"level >= {low}").select("grp", "level", "idx", "hash")
    got = asked.join(upper_nodes, ["grp", "level", "idx"])
    side = lambda left: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("idx") < F.col("own")) if left else (F.col("idx") > F.col("own")), F.struct("idx", "hash")))), lambda x: x["hash"]), "")
    by_level = got.groupBy("grp", "block", "level").agg(F.concat(side(True), F.lit("|"), side(False)).alias("side"))
    upper = by_level.groupBy("grp", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "side"))), lambda x: x["side"]), ",").alias("upper"))
    heads = heads.join(upper, ["grp", "block"], "left")
    if beyond is not None:
        heads = heads.join(beyond.select("grp", F.col("path").alias("beyond")), "grp", "left")
    path = F.concat_ws(",", *(F.nullif(F.col(c), F.lit("")) for c in ("upper", "beyond") if c in heads.columns))
    none = lambda t: F.lit(None).cast(t)
    heads = heads.select("grp", "block", F.lit(0).alias("kind"), none("int").alias("level"), none("long").alias("idx"), "n", none("string").alias("hash"), none("long").alias("num"), none("string").alias("txt"), path.alias("extra"))
    records = tree.nodes.where(f"level < {low}").select("grp", F.expr(f"idx div cast(pow({f}, {low} - level) as long)").alias("block"), F.lit(1).alias("kind"), "level", "idx", none("long").alias("n"), "hash", "num", "txt", "extra")
    met = heads.union(records).repartition("grp", "block").sortWithinPartitions("grp", "block", "kind", "level", "idx")
    return in_order(met, 2, _prove(f, low, paths), PROVEN)


# --- documents
@dataclass
class Manifest:
    """The trees of the groups, the tree of their roots, and the root of all (null for an empty table)."""

    trees: Tree
    top: Tree
    root: str | None


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest of leaves: grp, num, txt, hash, extra."""
    trees = build(leaves, fanout)
    none = F.lit(None).cast("string")
    top = build(trees.roots.select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("num"), F.col("grp").alias("txt"), "hash", none.alias("extra")), fanout)
    found = top.roots.first()
    return Manifest(trees, top, found and found["hash"])


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents by lang; extra is the digest of the row with one more in n_chars, where tampered holds."""
    own = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    more = {**own, "n_chars": F.col("n_chars").cast("decimal(20)") + 1}
    changed = F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(list(more.values())))
    return docs.select(group_key(F.col("lang")).alias("grp"), F.col("doc_id").cast("long").alias("num"), F.lit(None).cast("string").alias("txt"), leaf_digest(list(own.values())).alias("hash"), changed.alias("extra"))


def seventh() -> Column:
    """Rows that are tampered with: 7 divides the crc32 of the id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))


def verify_documents(docs: DataFrame, tampered: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of documents."""
    m = manifest(document_leaves(docs, seventh() if tampered is None else tampered), fanout)
    above = materialise(prove(m.top, paths=True).select(F.col("txt").alias("grp"), "path", F.col("hash").alias("subroot")), "merkle-top")
    rows = prove(m.trees, above).join(above.select("grp", "subroot"), "grp")
    root = F.lit(m.root).cast("string")
    return rows.select(F.col("num").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", root.alias("root"), F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"))


_FIELD = "case when {0} is null then '-' else strlen({0}::varchar) || ':' || {0}::varchar end"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
_BITS = "flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, {_BITS}), lambda a, b: xor(a >> 1, ((xor(a, b) & 1) * 3988292384)::bigint)), 4294967295)"

ORACLE = f"""with recursive
leaves as (select doc_id, lang, sha256({_FIELDS}) as leaf, case when {_CRC} % 7 = 0 and n_chars is not null then sha256({_FIELDS.replace("n_chars::varchar", "(n_chars + 1)::varchar")}) end as changed from documents),
ranked as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by lang) as n from leaves),
tree as (select lang, 0 as lvl, idx, n, leaf as h from ranked
  union all select lang, lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from tree where n > 1 group by lang, lvl, idx // 2),
subs as (select lang, h, row_number() over (order by lang nulls first) - 1 as idx, count(*) over () as n from tree where n = 1),
top as (select 0 as lvl, idx, n, h from subs
  union all select lvl + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' order by idx)) from top where n > 1 group by lvl, idx // 2),
fold as (select lang, doc_id, leaf, idx as i, 0 as lvl, idx, n, coalesce(changed, leaf) as h, '' as path from ranked
  union all select f.lang, f.doc_id, f.leaf, f.i, f.lvl + 1, f.idx // 2, (f.n + 1) // 2, sha256(case when f.idx % 2 = 0 then f.h || coalesce(s.h, '') else s.h || f.h end), f.path || coalesce(s.h, '')
  from fold f left join tree s on s.lang is not distinct from f.lang and s.lvl = f.lvl and s.idx = xor(f.idx, 1) where f.n > 1),
folded as (select f.lang, f.doc_id, f.leaf, f.i, s.h as subroot, 0 as lvl, s.idx, s.n, f.h, f.path from fold f join subs s on s.lang is not distinct from f.lang where f.n = 1
  union all select f.lang, f.doc_id, f.leaf, f.i, f.subroot, f.lvl + 1, f.idx // 2, (f.n + 1) // 2, sha256(case when f.idx % 2 = 0 then f.h || coalesce(s.h, '') else s.h || f.h end), f.path || coalesce(s.h, '')
  from folded f left join top s on s.lvl = f.lvl and s.idx = xor(f.idx, 1) where f.n > 1)
select doc_id, leaf, subroot, r.h as root, sha256(path) as proof_sha256, f.h as folded_root, f.h = r.h as verified from folded f, (select h from top where n = 1) r where f.n = 1"""
