"""Operator 1: exact top-k search by inner product with dual cover trees.

Vectors become integers, floor(scale * x). A cover tree over a bounded sample (at most SAMPLE vectors) gives at most
CELLS centres, or more for many vectors; every vector goes to its nearest centre, and a cell of many vectors is cut into
chunks by a hash of the id, of about CHUNK of them at most. In each chunk a cover tree is built and
stored with its vectors as a file of the shared folder. Queries are grouped in the same way, with trees of their own.
What is shuffled between groups and chunks are names; tasks read the trees they need.

First each query group meets the chunks of its own cell, which gives every query k scores and the group its worst kth.
A cell whose bound for a group (centres and covering radii, by Cauchy-Schwarz) lies under that worst score is pruned
for the whole group. On the chunks of the cells that are left, both trees descend together, and a pair of nodes is
pruned when its bound lies under the worst kth score of the queries below the query node. Leaves that are left are
multiplied out, together with those beside them that are left too, in blocks: where vectors have no clusters little is
pruned, and the work is that of a matrix product. It is in float32 if norms are small enough for exact sums (below 2^24),
else in float64 (below 2^53). A task meets some groups with some chunks, one after another; the worst scores rise as it goes,
and it gives k rows for each query at its end. Ties go to the smaller id and are never pruned (only lower bounds are). A
query's results from all tasks meet in one window.

Vectors with components for which float64 sums might not be exact (beyond +-LARGEST after scaling, or less if there are
very many dimensions) stay out of the trees: they meet all others block by block, and what float64 cannot rule out is
scored in integers. Integers or scores beyond 64 bits raise an error, as they do in SQL.

Vectors that are null or have null or non-finite components take no part, nor do those with a null id. Shorter vectors count as having zeros at the end. A
repeated id is a row of its own, but a query never meets a row of its own id. With fewer than k candidates all are
given. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pageflow.llm.files import file_size, read_range, write_whole
from pageflow.session import materialise, shared_dir, ship

#: Rows to find the centres from, centres (they grow with the rows, up to the second number), rows of a chunk, queries of a
#: group, rows of a tree's leaf, pairs of a group and a chunk that one task meets.
SAMPLE, CELLS, MOST_CELLS, CHUNK, GROUP, LEAF, TOGETHER = 4096, 32, 1024, 65_536, 4096, 512, 64
#: Components of a chunk and of a group at most: wider vectors make smaller ones.
CHUNK_SIZE, GROUP_SIZE = 1 << 22, 1 << 18
#: Children of a tree's node, rows of queries and of vectors that are multiplied at once, rows between two leaves that are
#: multiplied with them sooner than passed over.
FAN, TILE, ACROSS, GAP = 16, 512, 1024, 256
#: Partitions of a meeting at most.
MOST_TASKS = 8000
LARGEST = 1 << 20
#: Sums of products of integer vectors up to this norm are exact in float32, and their squared distances up to the second in float64.
FLOAT32, FLOAT64 = 2.0**12, 2.0**25
#: Rows of a block of the exact search.
EXACT = 4096
RESULT = "query_id long, vec_id long, score long"


# --- cover trees
class Tree:
    """A cover tree stored flat: rows in tree order; of each node its first row (its centre), end, radius and children."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, first: np.ndarray, end: np.ndarray, radius: np.ndarray, kids: np.ndarray):
        self.ids, self.rows, self.first, self.end, self.radius, self.kids = ids, rows, first, end, radius, kids
        self.centre = rows[first].astype(np.float64)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.inner = (kids >= 0).any(axis=1)
        self.leaves = np.flatnonzero(~self.inner)  # in the order of their rows, which they share out

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Tree:
        """Each node's points are dealt to centres that keep apart by half the node's radius; a child's radius is measured.

        Where that takes more centres than FAN, a child may keep most points; it is cut by their distance from its centre, so
        that no child has over half of its node's points.
        """
        order: list[np.ndarray] = []
        first, end, radius, kids = [], [], [], []
        square = (rows**2).sum(axis=1)
        plain = len(rows) > 0 and square.max() > FLOAT64**2  # differences first: slower, without cancellation
        done = 0

        def add(at: np.ndarray) -> int:
            """at: positions of the node's rows, its centre in front."""
            nonlocal done
            node, mine, squares = len(first), rows[at], square[at]

            def distances(i: int) -> np.ndarray:
                return np.sqrt(((mine - mine[i]) ** 2).sum(axis=1) if plain else squares + squares[i] - 2 * (mine @ mine[i]))

            away = distances(0)
            first.append(done)
            radius.append(float(away.max()))
            end.append(0)
            kids.append([])
            if len(at) <= leaf or away.max() == 0:
                order.append(at)
                done += len(at)
            else:
                parts = [at[x] for x in split(away, distances)]
                del mine, squares
                kids[node] += map(add, parts)
            end[node] = done
            return node

        def split(away: np.ndarray, distances: Callable[[int], np.ndarray]) -> list[np.ndarray]:
            apart = away.max() / 2
            near, owner, centres = away.copy(), np.zeros(len(away), np.int64), [0]
            while near[far := int(near.argmax())] > apart and len(centres) < FAN:
                d = distances(far)
                closer = d < near
                near[closer], owner[closer] = d[closer], len(centres)
                centres.append(far)
            parts = []
            for k, c in enumerate(centres):
                own = np.flatnonzero(owner == k)
                own = np.concatenate([[c], own[own != c]])
                if 2 * len(own) > len(away):
                    own = own[np.argsort(near[own], kind="stable")]
                    parts += [own[: len(own) // 2], own[len(own) // 2 :]]
                else:
                    parts.append(own)
            return parts

        if len(ids):
            add(np.arange(len(ids)))
        by = np.concatenate(order) if order else np.zeros(0, np.int64)
        width = max([1, *map(len, kids)])
        table = np.full((len(first), width), -1, np.int32)
        for i, k in enumerate(kids):
            table[i, : len(k)] = k
        return cls(ids[by], rows[by], np.array(first, np.int64), np.array(end, np.int64), np.array(radius), table)

    def pack(self) -> bytes:
        out = io.BytesIO()
        small = not self.rows.size or np.abs(self.rows).max() < 1 << 15
        np.savez(out, ids=self.ids.astype("<i8"), rows=self.rows.astype("<i2" if small else "<i4"), first=self.first, end=self.end, radius=self.radius, kids=self.kids)
        return out.getvalue()

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        """Rows in float32 if that is exact between trees that have them so."""
        x = np.load(io.BytesIO(data))
        rows = x["rows"].astype(np.float32)
        if x["rows"].dtype.itemsize > 2 or np.einsum("ij,ij->i", rows, rows).max(initial=0) >= FLOAT32**2:
            rows = x["rows"].astype(np.float64)
        return cls(x["ids"], rows, x["first"], x["end"], x["radius"], x["kids"])

    @classmethod
    def read(cls, uri: str) -> Tree:
        return cls.unpack(read_range(uri, 0, file_size(uri)))


#: A stored tree: its chunk, the greatest distance from the cell's centre, its file, and the radius, centre and ids of its root.
TREE = "cell int, chunk int, away double, path string, radius double, centre array<double>, ids array<long>"


def pair_bounds(q: Tree, a: np.ndarray | slice, r: Tree, b: np.ndarray | slice) -> np.ndarray:
    """Of each node a of q and b of r: no product of a row under the one and one under the other is greater."""
    far_a, far_b = q.radius[a, None], r.radius[None, b]
    norm_a, norm_b = q.norm[a, None], r.norm[None, b]
    return q.centre[a] @ r.centre[b].T + far_a * norm_b + far_b * norm_a + far_a * far_b + 1e-12 * (far_a + norm_a) * (far_b + norm_b) + 1e-3


def pair_bound(q: Tree, a: int, r: Tree, b: int) -> float:
    """No product of a row under q's node a and one under r's node b is greater."""
    return float(pair_bounds(q, np.array([a]), r, np.array([b]))[0, 0])


class Best:
    """The k best (score, -id) of each query of a tree, kept as sorted arrays."""

    def __init__(self, n: int, k: int, worst: np.ndarray):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.floor, self.worst = worst.copy(), worst.copy()  # known from elsewhere: scores under it cannot count
        self.own, self.buffer = np.zeros(n, np.int64), np.empty(0, np.uint8)

    def against(self, queries: Tree, refs: Tree) -> None:
        """What follows is about these vectors. No query meets its own id: how many of them have it."""
        inside = np.sort(refs.ids)
        self.own = np.searchsorted(inside, queries.ids, "right") - np.searchsorted(inside, queries.ids, "left")
        if (size := TILE * ACROSS * np.result_type(queries.rows, refs.rows).itemsize) > len(self.buffer):
            self.buffer = np.empty(size, np.uint8)

    def products(self, queries: Tree, rows: slice, refs: Tree, at: slice) -> np.ndarray:
        """In a buffer that the next call takes again."""
        shape, kind = (rows.stop - rows.start, at.stop - at.start), np.result_type(queries.rows, refs.rows)
        out = self.buffer[: shape[0] * shape[1] * kind.itemsize].view(kind).reshape(shape)
        return np.matmul(queries.rows[rows], refs.rows[at].T, out=out)

    def raise_floor(self, queries: Tree, rows: slice, refs: Tree, at: slice) -> None:
        """The kth score among these vectors, which are still to be met: no lower one counts."""
        for i in range(rows.start, rows.stop, TILE):
            mine = slice(i, min(i + TILE, rows.stop))
            if (k := self.k + self.own[mine].max()) <= at.stop - at.start:
                self.floor[mine] = np.maximum(self.floor[mine], np.partition(self.products(queries, mine, refs, at), -k, axis=1)[:, -k])
                self.worst[mine] = np.maximum(self.worst[mine], self.floor[mine])

    def meet(self, queries: Tree, rows: slice, refs: Tree, at: slice) -> None:
        for i in range(rows.start, rows.stop, TILE):
            mine = slice(i, min(i + TILE, rows.stop))
            worst, found, many = self.worst[mine], [], 0  # a view: put raises it
            for j in range(at.start, at.stop, ACROSS):
                theirs = slice(j, min(j + ACROSS, at.stop))
                product, ids = self.products(queries, mine, refs, theirs), refs.ids[theirs]
                top = product.max(axis=1)
                hit = top > worst
                if (even := top == worst).any():  # a tie counts if its id can be smaller
                    hit |= even & (ids.min() < self.id[mine, -1])
                if hit.any():
                    hit = np.flatnonzero(hit)
                    found.append(self.candidates(hit + i, product[hit], ids))
                    many += len(found[-1][0])
                    if many > self.k * len(worst):
                        self.put(queries, found)
                        found, many = [], 0
            if found:
                self.put(queries, found)

    def candidates(self, at: np.ndarray, product: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """product: of the queries at these places with vectors of these ids. Places, scores and ids of all that can count, ties included."""
        # in the products' type: rounding keeps the order
        least = np.maximum(self.worst[at], np.finfo(product.dtype).min).astype(product.dtype)
        counts = product >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(counts, axis=1) > 4 * self.k)
        if len(many) and (k := self.k + self.own[at[many]].max()) <= len(ids):
            least[many] = np.maximum(least[many], np.partition(product[many], -k, axis=1)[:, -k])
            counts[many] = product[many] >= least[many, None]
        who, which = np.nonzero(counts)
        return at[who], product[who, which], ids[which]

    def put(self, queries: Tree, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        at, score, id_ = (np.concatenate(x) for x in zip(*found))
        new = ((score > self.score[at, -1]) | (id_ < self.id[at, -1])) & (id_ != queries.ids[at])
        if not new.any():
            return
        changed = np.unique(at[new])
        at = np.concatenate([np.repeat(changed, self.k), at[new]])
        score = np.concatenate([self.score[changed].ravel(), score[new].astype(np.float64)])
        id_ = np.concatenate([self.id[changed].ravel(), id_[new]])
        by = np.lexsort((id_, -score, at))
        by = by[np.searchsorted(at[by], changed)[:, None] + np.arange(self.k)]
        self.score[changed], self.id[changed] = score[by], id_[by]
        self.worst[changed] = np.maximum(self.score[changed, -1], self.floor[changed])


def dual_search(queries: Tree, refs: Tree, best: Best) -> None:
    """Descend both trees level by level; leaves that are left are multiplied, together with those beside them."""
    if not len(queries.first) or not len(refs.first):
        return
    best.against(queries, refs)
    bounds = pair_bounds(queries, slice(None), refs, slice(None))
    for a in queries.leaves:  # the most promising place tells a floor, where nothing is known
        rows = slice(queries.first[a], queries.end[a])
        if best.worst[rows].min() == -np.inf:
            b = 0
            while refs.inner[b]:
                kids = refs.kids[b][refs.kids[b] >= 0]
                kid = kids[bounds[a, kids].argmax()]
                if refs.end[kid] - refs.first[kid] <= 4 * best.k:
                    break
                b = kid
            best.raise_floor(queries, rows, refs, slice(refs.first[b], min(refs.end[b], refs.first[b] + ACROSS)))
    worst = np.array([best.worst[i:j].min() for i, j in zip(queries.first, queries.end)])
    left = np.zeros(bounds.shape, bool)
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(a):
        keep = bounds[a, b] >= worst[a]
        a, b = a[keep], b[keep]
        open_a, open_b = queries.inner[a], refs.inner[b]
        leaf = ~open_a & ~open_b
        left[a[leaf], b[leaf]] = True
        down = open_b & (~open_a | (refs.end[b] - refs.first[b] >= queries.end[a] - queries.first[a]))
        up = ~leaf & ~down
        kids_b, kids_a = refs.kids[b[down]], queries.kids[a[up]]
        at, _ = np.nonzero(kids_b >= 0)
        to, _ = np.nonzero(kids_a >= 0)
        a, b = np.concatenate([a[down][at], kids_a[kids_a >= 0]]), np.concatenate([kids_b[kids_b >= 0], b[up][to]])
    left = left[np.ix_(queries.leaves, refs.leaves)]
    first, end = refs.first[refs.leaves], refs.end[refs.leaves]
    own, size = queries.end[queries.leaves] - queries.first[queries.leaves], end - first
    i = 0
    while i < len(own):
        wanted, rows, cost, j = left[i], own[i], own[i] * (left[i] @ size), i + 1
        while j < len(own) and rows + own[j] <= TILE:  # leaves side by side that want nearly the same
            both, alone = wanted | left[j], own[j] * (left[j] @ size)
            if (rows + own[j]) * (both @ size) > 1.25 * (cost + alone):
                break
            wanted, rows, cost, j = both, rows + own[j], cost + alone, j + 1
        at = np.flatnonzero(wanted)
        if len(at):
            mine = slice(queries.first[queries.leaves[i]], queries.end[queries.leaves[j - 1]])
            cuts = np.flatnonzero(first[at[1:]] - end[at[:-1]] > GAP)
            for x, y in zip(first[at[np.concatenate([[0], cuts + 1])]], end[at[np.concatenate([cuts, [len(at) - 1]])]]):
                best.meet(queries, mine, refs, slice(x, y))
        i = j


# --- the distributed search
SCALED = "vec_id long, v binary, asked boolean, width int, low long, high long"


def _bytes(rows: bytes, sizes: np.ndarray) -> pa.Array:
    """A binary column of rows of these sizes, given as one run of bytes."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(rows)])


def scaled(vectors: DataFrame, scale: float, id_col: str, vector_col: str, queries: Column) -> DataFrame:
    """Of the vectors that take part: vec_id, v, whether they are queries, the number of components, the lowest and the highest.

    v has the scaled integers, in two bytes each if a row's fit them, else in eight: columns of numbers cost Spark much more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = b.column("x").flatten().to_numpy(zero_copy_only=False), pc.list_value_length(b.column("x")).to_numpy()
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])  # null: not a number here
            end = np.cumsum(n)
            fine = bad[end] == bad[end - n]
            x, n = float(scale) * x[np.repeat(fine, n)].astype(np.float64), n[fine]
            if (np.abs(x) >= 2.0**63).any():
                raise OverflowError("a scaled component is beyond 64 bits")
            v, start, some = np.floor(x).astype(np.int64), np.cumsum(n) - n, n > 0
            low, high = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            if some.any():
                low[some], high[some] = np.minimum.reduceat(v, start[some]), np.maximum.reduceat(v, start[some])
            short = (low >= -(1 << 15)) & (high < 1 << 15)
            data = v.astype("<i2").tobytes() if short.all() else b"".join(x.astype("<i2" if s else "<i8").tobytes() for x, s in zip(np.split(v, start[1:]), short))
            kept = pa.array(fine)
            columns = [b.column("vec_id").filter(kept), _bytes(data, n * np.where(short, 2, 8)), b.column("asked").filter(kept), pa.array(n, pa.int32()), pa.array(low), pa.array(high)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "asked", "width", "low", "high"])

    x = F.col(vector_col)
    if vectors.select(x).dtypes[0][1] not in ("array<float>", "array<double>"):
        x = x.cast("array<double>")
    some = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    return some.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(queries, F.lit(False)).alias("asked")).mapInArrow(run, SCALED)


def _integers(v: list[bytes], widths: np.ndarray, width: int) -> np.ndarray:
    """Rows of equal width, zeros at the end."""
    widths = np.asarray(widths, np.int64)
    if (widths == width).all() and all(len(x) == 2 * width for x in v):
        return np.frombuffer(b"".join(v), "<i2").reshape(len(v), width).astype(np.int64)
    out = np.zeros((len(v), width), np.int64)
    for i, (x, n) in enumerate(zip(v, widths)):
        out[i, :n] = np.frombuffer(x, "<i2" if len(x) == 2 * n else "<i8")
    return out


def exact_best(q_ids: np.ndarray, q: np.ndarray, r_ids: np.ndarray, r: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of the k best for each query, in integers: float64 only rules out what its error cannot lift."""
    qf, rf = q.astype(np.float64), r.astype(np.float64)
    product = qf @ rf.T
    slack = (q.shape[1] + 8) * 2.0**-51 * (np.abs(qf) @ np.abs(rf).T) + 1
    own, out = q_ids[:, None] == r_ids[None], []
    low, high = np.where(own, -np.inf, product - slack), np.where(own, -np.inf, product + slack)
    for i in range(len(q)):
        least = np.partition(low[i], -k)[-k] if len(r) > k else -np.inf
        at = np.flatnonzero((high[i] >= least) & ~own[i])
        mine = q[i].tolist()
        scores = sorted((-sum(a * b for a, b in zip(mine, r[j].tolist())), int(r_ids[j])) for j in at)[:k]
        if any(abs(s) >= 1 << 63 for s, _ in scores):
            raise OverflowError("a score is beyond 64 bits")
        out += [(int(q_ids[i]), j, -s) for s, j in scores]
    return out


def _exact(asked: DataFrame, rows: DataFrame, k: int, width: int, many_asked: int, many_rows: int) -> DataFrame:
    """query_id, vec_id, score of the k best of every query in every block of rows."""
    a, b = max(1, -(-many_asked // GROUP)), max(1, -(-many_rows // EXACT))
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def integers(pdf: pd.DataFrame) -> np.ndarray:
        return _integers(pdf["v"].tolist(), pdf["width"], width)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = exact_best(left["vec_id"].to_numpy(np.int64), integers(left), right["vec_id"].to_numpy(np.int64), integers(right), k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    left = asked.select("vec_id", "v", "width", dealt(a).alias("qb"), each(b).alias("rb")).groupBy("qb", "rb")
    right = rows.select("vec_id", "v", "width", dealt(b).alias("rb"), each(a).alias("qb")).groupBy("qb", "rb")
    return left.cogroup(right).applyInPandas(run, RESULT)


def choose_centres(sample: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """The top of a cover tree: level by level, the radius halved, while there are few enough centres."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, near = [0], np.sqrt(((sample - sample[0]) ** 2).sum(axis=1))
    while len(chosen) < cells and (far := int(near.argmax())) and near[far] > 0:
        chosen.append(far)
        near = np.minimum(near, np.sqrt(((sample - sample[far]) ** 2).sum(axis=1)))
    return sample[chosen]


def _dealt(rows: DataFrame, centres: np.ndarray, code: str) -> DataFrame:
    """vec_id, v, whose components are bytes by the type ``code``, and cell, the nearest centre."""
    width, square = centres.shape[1], (centres**2).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _integers(b.column("v").to_pylist(), b.column("width").to_numpy(), width)
            cell = (square - 2 * m.astype(np.float64) @ centres.T).argmin(axis=1) if len(m) else np.zeros(0)
            packed = _bytes(m.astype(code).tobytes(), np.full(len(m), width * np.dtype(code).itemsize))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), packed, pa.array(cell, pa.int32())], ["vec_id", "v", "cell"])

    return rows.select("vec_id", "v", "width").mapInArrow(run, "vec_id long, v binary, cell int")


def _trees(dealt: DataFrame, counts: dict[int, int], size: int, code: str, centres: np.ndarray, folder: str, with_ids: bool) -> DataFrame:
    """One tree for each chunk of a cell, written as a file of the shared folder; its facts as a row."""
    chunks = F.lit([max(1, -(-counts.get(c, 0) // size)) for c in range(len(centres))]).cast("array<int>")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        m = np.frombuffer(b"".join(pdf["v"]), code).reshape(len(pdf), centres.shape[1]).astype(np.float64)
        away = np.sqrt(((m - centres[key[0]]) ** 2).sum(axis=1)).max()
        tree = Tree.build(pdf["vec_id"].to_numpy(np.int64), m)
        path = f"{folder}/{key[0]}-{key[1]}-{TaskContext.get().taskAttemptId()}.npz"
        write_whole(path, [tree.pack()])
        ids = tree.ids.tolist() if with_ids else []
        return pd.DataFrame([{"cell": key[0], "chunk": key[1], "away": float(away), "path": path, "radius": float(tree.radius[0]), "centre": tree.rows[tree.first[0]].tolist(), "ids": ids}])

    keyed = dealt.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.get(chunks, F.col("cell"))).cast("int"))
    return keyed.groupBy("cell", "chunk").applyInPandas(build, TREE)


def partitions_for(pairs: int, least: int) -> int:
    """As many partitions as give each about TOGETHER pairs of a group and a chunk; ``least`` while there are fewer, never over MOST_TASKS."""
    return max(1, min(pairs, max(least, min(MOST_TASKS, -(-pairs // TOGETHER)))))


def side_for(pairs: int, least: int) -> int:
    """Groups, and chunks, of a task: the more the less is read and given; fewer while there would be under four tasks for each of ``least`` partitions."""
    return max(1, min(isqrt(TOGETHER), isqrt(pairs // (4 * max(1, least)))))


def _meet(pairs: DataFrame, chunks: DataFrame, k: int, many: int) -> DataFrame:
    """query_id, vec_id, score of the k best of every query among the chunks it meets in a task.

    pairs, of which there are ``many``: cell, chunk, task, queries and worst, the files of a group's tree and of its worst
    scores so far (null: none). Rows hold names only. A task number stands for some groups and some chunks; numbers are dealt
    to partitions in proportion to the pairs, sorted by chunk: a task reads a chunk's tree once and keeps its groups, whose
    worst scores rise from chunk to chunk, and gives k rows for each query at its end.
    """
    n = partitions_for(many, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def found(groups: Iterable[tuple[Tree, Best]]) -> Iterator[pd.DataFrame]:
        for queries, best in groups:
            q, j = np.nonzero(np.isfinite(best.score) & (best.score >= best.floor[:, None]))
            yield pd.DataFrame({"query_id": queries.ids[q], "vec_id": best.id[q, j], "score": best.score[q, j].astype(np.int64)})

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, refs, groups = None, None, None, {}
        for pdf in parts:
            for task, path, asked, told in zip(pdf["task"], pdf["path"], pdf["queries"], pdf["worst"]):
                if task != now:
                    yield from found(groups.values())
                    now, groups = task, {}
                if path != at:
                    at, refs = path, Tree.read(path)
                if asked not in groups:
                    queries = Tree.read(asked)
                    worst = np.frombuffer(read_range(told, 0, file_size(told)), "<f8") if isinstance(told, str) else np.full(len(queries.ids), -np.inf)
                    groups[asked] = queries, Best(len(queries.ids), k, worst)
                dual_search(groups[asked][0], refs, groups[asked][1])
        yield from found(groups.values())

    named = pairs.join(chunks.select("cell", "chunk", "path"), ["cell", "chunk"])
    return named.repartitionById(n, F.pmod("task", F.lit(n)).cast("int")).sortWithinPartitions("task", "path", "queries").mapInPandas(run, RESULT)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", report: dict[str, int] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for every row that the condition ``queries`` (on id_col) holds for, its k best others.

    report, if given, gets the number of pairs of a query group and a chunk, and of those that were not pruned.
    """
    spark = vectors.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark)}/op1-{uuid.uuid4().hex}"
    all_rows = materialise(scaled(vectors, scale, id_col, vector_col, queries), "op1-rows")
    width = all_rows.agg(F.coalesce(F.max("width"), F.lit(0))).first()[0]
    limit = min(LARGEST, isqrt((1 << 53) // max(1, width)))
    large = (F.col("low") <= -limit) | (F.col("high") >= limit)
    facts = all_rows.agg(F.count("*"), F.count_if(~large), F.count_if("asked"), F.count_if(F.col("asked") & ~large), F.min(F.when(~large, F.col("low"))), F.max(F.when(~large, F.col("high"))))
    total, n, asked_total, asked_n, low, high = (x or 0 for x in facts.first())
    all_asked = all_rows.where("asked")
    rows, asked = all_rows.where(~large), all_asked.where(~large)
    code = "<i2" if max(-low, high) < 1 << 15 else "<i4"
    chunk, group = max(1, min(CHUNK, CHUNK_SIZE // max(1, width))), max(1, min(GROUP, GROUP_SIZE // max(1, width)))
    exact = []
    if total > n:
        exact.append(_exact(asked, all_rows.where(large), k, width, asked_n, total - n))
    if asked_total > asked_n:
        exact.append(_exact(all_asked.where(large), all_rows, k, width, asked_total - asked_n, total))
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) * n < SAMPLE * 1_000_000
    taken = rows.where(share).select("v", "width").limit(2 * SAMPLE).collect()  # bounded
    sample = _integers([bytes(r.v) for r in taken], [r.width for r in taken], width).astype(np.float64)
    cells = max(1, min(n // 1024, max(CELLS, n // (2 * chunk)), MOST_CELLS))
    centres = choose_centres(sample[np.lexsort(sample.T)] if width and len(sample) else sample, cells)
    cells, asked_cells = materialise(_dealt(rows, centres, code), "op1-cells"), materialise(_dealt(asked, centres, code), "op1-asked")
    count = lambda df: {r["cell"]: r["count"] for r in df.groupBy("cell").count().collect()}  # noqa: E731  a row per cell
    sizes, asked_sizes = count(cells), count(asked_cells)
    chunks = materialise(_trees(cells, sizes, chunk, code, centres, f"{folder}/chunks", False), "op1-chunks")
    groups = materialise(_trees(asked_cells, asked_sizes, group, code, centres, f"{folder}/groups", True), "op1-groups").select("cell", F.col("chunk").alias("group"), F.col("path").alias("queries"), "radius", "centre", "ids")
    # a row, or a number, for each cell
    reach = {r["cell"]: r["away"] for r in chunks.groupBy("cell").agg(F.max("away").alias("away")).collect()}
    in_cell = {c: -(-m // chunk) for c, m in sizes.items()}
    groups_in = {c: -(-m // group) for c, m in asked_sizes.items()}
    many_chunks, many_groups = sum(in_cell.values()), sum(groups_in.values())
    before = dict(zip(sorted(in_cell), accumulate((in_cell[c] for c in sorted(in_cell)), initial=0)))  # numbers of a cell's first chunk
    groups_before = dict(zip(sorted(groups_in), accumulate((groups_in[c] for c in sorted(groups_in)), initial=0)))
    side = side_for(many_groups * many_chunks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    stripes = max(1, -(-many_chunks // side))
    # the chunks of a group's own cell, or of the nearest that has any
    full = sorted(in_cell)
    home = {c: min(full, key=lambda d: ((centres[c] - centres[d]) ** 2).sum()) for c in range(len(centres))} if full else {}
    norms = np.sqrt((centres**2).sum(axis=1))
    own_stripes = {c: -(-in_cell[home[c]] // side) for c in sorted(groups_in)} if home else {}
    own_before = dict(zip(own_stripes, accumulate((groups_in[c] * x for c, x in own_stripes.items()), initial=0)))

    def to_pairs(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        for g in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            c, number = g["cell"], g["group"]
            if first:
                at, told, wanted = own_before[c] + number * own_stripes[c], None, [(home[c], 0)]
            else:
                known = dict(zip(g["known_ids"] or [], g["known_worst"] or []))
                worst = np.array([known.get(i, -np.inf) for i in g["ids"]])
                centre, lowest = np.array(g["centre"]), worst.min()
                away, size = np.array([reach[d] for d in full]), np.linalg.norm(centre)
                bound = centres[full] @ centre + g["radius"] * norms[full] + away * size + g["radius"] * away + 1e-12 * (g["radius"] + size) * (norms[full] + away) + 1e-3
                told = f"{g['queries']}.{TaskContext.get().taskAttemptId()}.worst"
                write_whole(told, [worst.astype("<f8").tobytes()])
                at, wanted = (groups_before[c] + number) // side * stripes, [(d, before[d]) for d, x in zip(full, bound.tolist()) if x >= lowest and d != home[c]]
            out = [{"cell": d, "chunk": i, "task": at + (start + i) // side, "queries": g["queries"], "worst": told} for d, start in wanted for i in range(in_cell[d])]
            yield pa.RecordBatch.from_pylist(out, schema=PAIRS)

    schema = "cell int, chunk int, task long, queries string, worst string"
    near = sum(m * in_cell[home[c]] for c, m in groups_in.items() if home)
    own = _best_of(_meet(groups.select("cell", "group", "queries").mapInArrow(lambda it: to_pairs(it, True), schema), chunks, k, near), k).select("query_id", "vec_id", "score")
    own = materialise(own, "op1-own")
    kth = own.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("have")).where(F.col("have") >= k)
    # the worst known score of each query goes to its group: as many rows as queries, by group
    where = asked_cells.select("vec_id", "cell", F.pmod(F.xxhash64("vec_id"), F.get(F.lit([groups_in.get(c, 1) for c in range(len(centres))]).cast("array<int>"), F.col("cell"))).cast("int").alias("group"))
    told = where.join(kth, where["vec_id"] == kth["query_id"]).groupBy("cell", "group").agg(F.collect_list("vec_id").alias("known_ids"), F.collect_list(F.col("kth").cast("double")).alias("known_worst"))
    pairs = materialise(groups.join(told, ["cell", "group"], "left").mapInArrow(lambda it: to_pairs(it, False), schema), "op1-pairs")
    left = pairs.count()
    if report is not None:
        report |= {"pairs": many_groups * many_chunks, "met": left + near}
    far = _meet(pairs, chunks, k, left)
    found = reduce(DataFrame.unionByName, exact, own.unionByName(far))
    return _best_of(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


PAIRS = pa.schema([("cell", pa.int32()), ("chunk", pa.int32()), ("task", pa.int64()), ("queries", pa.string()), ("worst", pa.string())])

#: The same by SQL.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""
