"""Operator 12: document quality by a support vector machine over naive Bayes features.

A text's features are the n-grams that occur in it, present or not: single tokens and pairs, and runs of one to three token
shapes (case, digits, the sign itself, a token that repeats the one before), hashed to BUCKETS. Each feature is scaled by
its log-count ratio: how much more often documents of label 1 have it than documents of label 0. Rows are scaled to length
one, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become scores by a logistic curve that is
fitted to margins of rows which their model had not seen.

Ratios are counted over all labelled rows that are not held out, in the tasks that read them, as BUCKETS pairs of counts a task
at most. The linear model is fitted on the driver on about TRAIN_ROWS of them with different texts, taken by a hash over all
(the documented bound). Every text is scored whole, from its text alone.

A null text is an empty one. A text without a token has no feature, and the score of the bias alone. Rows with null labels or ids
teach nothing; held_out is false for null ids. Repeated rows and labels each count. Without labels of both kinds every score is
the share of label 1, or 0.5 if there is none. Extra columns are not read. Memory: a portion of a batch, BUCKETS numbers,
and a bounded cache of tokens per worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageflow.llm.batches import batches_of, held, portions
from pageflow.session import materialise, ship

BUCKETS = 1 << 17
#: Labelled rows to fit the linear model on, about; features of one of them that are sent at most (others are taken by their hash).
TRAIN_ROWS, ROW_FEATURES = 8000, 20_000
#: Smoothing of counts; cost of an error; passes over the rows at most; least change of a pass that goes on.
ALPHA, COST, PASSES, TOLERANCE = 1.0, 1.0, 12, 0.02
#: Labels up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Tokens that a worker remembers.
TOKENS = 500_000

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    if token.islower():
        return "a"
    if token.isupper():
        return "A" if len(token) > 1 else "I"
    return "Aa" if token[0].isupper() and token[1:].islower() else "?"


class Features:
    """Feature ids of texts; one per worker."""

    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.known = np.empty((2, 1 << 12), np.uint64)  # of each token, hashes of its lower case and of its shape

    def _learn(self, new: list[str]) -> None:
        start = len(self.ids)
        self.ids.update(zip(new, range(start, start + len(new))))
        if len(self.ids) > self.known.shape[1]:
            self.known = np.concatenate([self.known, np.empty((2, len(self.ids)), np.uint64)], axis=1)
        self.known[0, start : len(self.ids)] = [zlib.crc32(t.lower().encode("utf-8", "surrogatepass")) + 1 for t in new]
        self.known[1, start : len(self.ids)] = [zlib.crc32(_shape(t).encode("utf-8", "surrogatepass"), 7) + 1 for t in new]

    def of_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a text's number and a feature that it has, ascending, each once."""
        cut = [_TOKEN.findall(t) if t else () for t in texts]
        tokens = list(chain.from_iterable(cut))
        if len(self.ids) > TOKENS:
            self.ids.clear()
        found = list(map(self.ids.get, tokens))
        if None in found:
            self._learn([t for t in dict.fromkeys(t for t, k in zip(tokens, found) if k is None)])
            found = list(map(self.ids.__getitem__, tokens))
        at = np.array(found, np.int64)
        of = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
        h, s = self.known[0, at], self.known[1, at]
        two, three = of[1:] == of[:-1], of[2:] == of[:-2]
        s[1:][two & (h[1:] == h[:-1])] = 3  # a token again
        kinds = [(of, h), (of[1:][two], (h[:-1] * _MIX + h[1:])[two]), (of, s), (of[1:][two], (s[:-1] * _MIX + s[1:])[two]), (of[2:][three], ((s[:-2] * _MIX + s[1:-1]) * _MIX + s[2:])[three])]
        both = np.sort(np.concatenate([n * BUCKETS + _hashed(x, kind) for kind, (n, x) in enumerate(kinds, 1)]))
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return np.divmod(both, BUCKETS)

    def of(self, text: str | None) -> np.ndarray:
        """The ascending ids of a text's features."""
        return self.of_texts([text])[1]


def _hashed(x: np.ndarray, kind: int) -> np.ndarray:
    """Of BUCKETS, by the high bits of two multiplications."""
    x = (x + np.uint64(kind)) * _MIX
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def features() -> Features:
    return held(("quality",), Features)


# --- training
GATHERED = "bucket int, zeros long, ones long, key long, label int, features binary"


def labelled(docs: DataFrame, labels: DataFrame, held_out: Column, label: str, id_col: str, text_col: str) -> DataFrame:
    """text and label (0 or 1) of the rows that may be learned from."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(known, "id").select("text", "label")


def gather(rows: DataFrame, share: float) -> DataFrame:
    """GATHERED: what each task counted for a bucket, and the features of about a share of the rows, by a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        counts, find = np.zeros((2, BUCKETS), np.int64), features()
        for b in batches:
            for part in portions(b):
                texts, given = (part.column(c).to_pylist() for c in ("text", "label"))
                of, every = find.of_texts(texts)
                own = np.array(given)[of]
                for label in (0, 1):
                    counts[label] += np.bincount(every[own == label], minlength=BUCKETS)
                ends = np.searchsorted(of, np.arange(len(texts) + 1)).tolist()
                for text, label, start, end in zip(texts, given, ends, ends[1:]):
                    found, key = every[start:end], zlib.crc32(text.encode())
                    if key < share * 2**32:
                        if len(found) > ROW_FEATURES:
                            found = np.sort(found[np.argsort(found * 2654435761 % (1 << 32), kind="stable")[:ROW_FEATURES]])
                        yield None, None, None, key, label, found.astype("<i4").tobytes()
        some = np.flatnonzero(counts.any(axis=0))
        yield from zip(some.tolist(), counts[0, some].tolist(), counts[1, some].tolist(), repeat(None), repeat(None), repeat(None))

    return rows.mapInArrow(lambda batches: batches_of(run(batches), GATHERED), GATHERED)


def ratios(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Log-count ratios of buckets from their counts of both labels."""
    p = np.log(counts + alpha) - np.log((counts + alpha).sum(axis=1, keepdims=True))
    return p[1] - p[0]


def _scaled(rows: list[np.ndarray], r: np.ndarray) -> list[np.ndarray]:
    """The values of rows' features: ratios, of length one; the bias follows."""
    out = []
    for x in rows:
        v = r[x]
        n = np.sqrt(v @ v)
        out.append(np.append(v / n if n else v, 1.0))
    return out


def fit(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of all buckets and the bias: hinge loss by dual coordinate descent, both labels of equal weight in sum."""
    at = [np.append(x, BUCKETS) for x in rows]
    values = _scaled(rows, r)
    square = np.array([v @ v for v in values])
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    w, alpha, rng = np.zeros(BUCKETS + 1), np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(PASSES):
        worst = 0.0
        for i in rng.permutation(len(y)).tolist():
            g = y[i] * (w[at[i]] @ values[i]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), cost[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]) * square[i])
                w[at[i]] += (new - alpha[i]) * y[i] * values[i]
                alpha[i] = new
        if worst < TOLERANCE:
            break
    return w


def _margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.array([w[np.append(x, BUCKETS)] @ v for x, v in zip(rows, _scaled(rows, r))])


def curve(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b of the logistic curve 1 / (1 + exp(-(a m + b))), by Newton's method, with targets drawn in by the counts."""
    ones, zeros = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones_like(margins)])
    ab = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(ab @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - t))
        ab = ab - step
        if np.abs(step).max() < 1e-6:
            break
    return float(ab[0]), float(ab[1])


class Model:
    """What a score needs: the ratios, the weights with the bias, the curve; or a constant."""

    def __init__(self, r: np.ndarray | None, w: np.ndarray | None, ab: tuple[float, float] | None, constant: float = 0.5):
        self.r, self.w, self.ab, self.constant = r, w, ab, constant

    def scores(self, n: int, of: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Scores of n texts from the pairs of of_texts."""
        if self.w is None:
            return np.full(n, self.constant)
        v = self.r[found].astype(np.float64)
        length = np.sqrt(np.bincount(of, v * v, minlength=n))
        m = np.bincount(of, self.w[found] * v, minlength=n) / np.where(length > 0, length, 1) + self.w[BUCKETS]
        return 1 / (1 + np.exp(-np.clip(self.ab[0] * m + self.ab[1], -30, 30)))


def fifth(id_col: str = "doc_id") -> Column:
    """Rows that are held out: 5 divides the crc32 of the id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", limit: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of labels (0 or 1, by id) whose rows are not held out."""
    ship(docs.sparkSession)
    n = labels.where(F.col(label).isin(0, 1) & ~held_out).count()
    found = materialise(gather(labelled(docs, labels, held_out, label, id_col, text_col), min(1.0, limit / max(n, 1))), "quality")
    counted = found.where("bucket is not null").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toPandas()  # BUCKETS rows at most
    # different texts, so that copies have no weight of their own; of two labels the smaller
    some = found.where("bucket is null").groupBy("key").agg(F.min(F.struct("label", "features")).alias("x")).select("key", "x.*").orderBy("key").limit(2 * limit).toPandas()
    rows = [np.frombuffer(x, "<i4").astype(np.int64) for x in some["features"]]
    y = np.where(some["label"].to_numpy(np.int64) == 1, 1, -1) if len(some) else np.empty(0, np.int64)
    ones, zeros = (y > 0).sum(), (y < 0).sum()
    if not ones or not zeros:
        return Model(None, None, None, float(ones / len(y)) if len(y) else 0.5)
    counts = np.zeros((2, BUCKETS), np.int64)
    counts[:, counted["bucket"].to_numpy()] = counted[["zeros", "ones"]].to_numpy(np.int64).T
    r = ratios(counts)
    unseen, fold = np.zeros(len(y)), np.arange(len(y)) % 3
    for k in range(3):
        train_, test = fold != k, fold == k
        if test.any() and (y[train_] > 0).any() and (y[train_] < 0).any():
            # ratios without the fold's own rows, so that its margins are those of unknown texts
            own = counts.copy()
            for i in np.flatnonzero(test):
                own[int(y[i] > 0), rows[i]] -= 1
            less = ratios(np.maximum(own, 0))
            w = fit([rows[i] for i in np.flatnonzero(train_)], y[train_], less)
            unseen[test] = _margins([rows[i] for i in np.flatnonzero(test)], less, w)
    return Model(r.astype(np.float32), fit(rows, y, r).astype(np.float32), curve(unseen, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row: one pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = features()
        for b in batches:
            for part in portions(b):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.num_rows, *find.of_texts(part.column(1).to_pylist())), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
