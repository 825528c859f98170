"""Operator 8: language identification by script ranges and a Viterbi path over words.

A word's script ranges narrow the languages that can have it to those seen with that script in training. Each word then
gets a score for every candidate: the sum of log probabilities of its character n-grams, hashed to BUCKETS. A Viterbi
path over the words of a text, with a penalty for each switch, labels spans of mixed-language text. The text's language
is the one with the most letters on the path; the score is its share of them.

Training reads at most about TRAIN_DOCS labelled documents of each language (the documented bound), taken by a hash of
the id over all of them, in one aggregation. Every text is labelled whole, and only its text is used.

A null text and one without a letter are ``und`` with score 0. Nothing is learned from null labels or ids that are held
out; if nothing is learned at all (an empty table), every text is ``und``. Repeated rows get repeated results, null ids
are kept and held_out is false for them. More than LANGS languages raise an error. Extra columns are not read. Memory: one portion of a batch, BUCKETS numbers per
language, and a bounded cache of word scores per worker.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageflow.llm.batches import held, portions
from pageflow.session import ship

BUCKETS = 1 << 16
#: Labelled documents of each language to learn from, about; longest n-gram.
TRAIN_DOCS, LONGEST = 4000, 4
#: Languages that a model may have; it and what is broadcast grow with their number, so more raise an error.
LANGS = 256
#: Cost of a change of language between two words, in nats; least share of a language's letters for a script to count.
SWITCH, SCRIPT_SHARE = 12.0, 0.001
#: Words whose scores a worker remembers; texts of more words than LONG are decoded one by one.
WORDS, LONG = 500_000, 2000

# Scripts and their main code point ranges.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
OTHER = len(SCRIPTS)
_STARTS, _ENDS, _NAMES = (np.array(x) for x in zip(*sorted((a, b, i) for i, r in enumerate(SCRIPTS.values()) for a, b in r)))

WORD = re.compile(r"[^\W\d_]+")


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), np.int64, len(words))
    at = np.searchsorted(_STARTS, first, "right") - 1
    return np.where((at >= 0) & (first <= _ENDS[at]), _NAMES[at], OTHER)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of lower-case words, ends marked, and the position of each one's word."""
    marked = [f"<{w.lower()}>" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(marked)), lengths)
    buckets, owners = [], []
    h = codes.copy()
    for k in range(2, LONGEST + 1):
        h = h[:-1] * np.uint64(0x100000001B3) + codes[k - 1 :]
        start = np.flatnonzero(np.arange(len(h)) + k <= ends[: len(h)])
        mixed = (h[start] + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(48)).astype(np.int64))
        owners.append(owner[start])
    return np.concatenate(buckets), np.concatenate(owners)


class Model:
    """Languages, log probabilities by bucket, and the languages of each script."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: languages by buckets, then scripts."""
        self.langs, self.name = langs, uuid.uuid4().hex
        by_gram, by_script = counts[:, :BUCKETS].astype(np.float64), counts[:, BUCKETS:].astype(np.float64)
        self.log = np.log((by_gram + 0.5) / (by_gram.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32).T.copy()
        self.of_script = by_script >= SCRIPT_SHARE * np.maximum(by_script.sum(axis=1, keepdims=True), 1)
        self.of_script = self.of_script.T.copy()  # script by language
        self.of_script[~self.of_script.any(axis=1)] = True  # a script never seen rules nothing out

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of candidate scores for each word, the best of all languages 0."""
        bucket, owner = grams(words)
        s = np.stack([np.bincount(owner, weights=self.log[bucket, k], minlength=len(words)) for k in range(len(self.langs))], axis=1)
        return np.where(self.of_script[scripts_of(words)], s - s.max(axis=1, keepdims=True), -1e4).astype(np.float32)


def training_sample(docs: DataFrame, held_out, per_lang: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """text and lang of about per_lang documents of each language, by a hash of the id."""
    usable = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = usable.groupBy(F.col(lang_col).cast("string").alias("lang_")).agg(F.count("*").alias("n"))
    picked = usable.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang_"), F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.lit("train")), F.lit(1_000_000)).alias("h"))
    known = sizes.limit(LANGS + 1).collect()
    if len(known) > LANGS:
        raise ValueError(f"over {LANGS} languages are labelled")
    sizes = docs.sparkSession.createDataFrame([tuple(r) for r in known], "lang_ string, n long")
    # one row per language, LANGS at most
    return picked.join(F.broadcast(sizes), "lang_").where(F.col("h") * F.col("n") < per_lang * 1_000_000).select("text", F.col("lang_").alias("lang"))


def count_features(sample: DataFrame) -> DataFrame:
    """lang, feature, n: n-gram buckets, then scripts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in portions(batch):
                by_lang: dict[str, Counter] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                    by_lang.setdefault(lang, Counter()).update(WORD.findall(text))
                for lang, found in by_lang.items():
                    words, times = list(found), np.fromiter(found.values(), np.float64, len(found))
                    if words:
                        bucket, owner = grams(words)
                        features, weights = np.concatenate([bucket, BUCKETS + scripts_of(words)]), np.concatenate([times[owner], times])
                        own = counts.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
                        own += np.bincount(features, weights=weights, minlength=len(own)).astype(np.int64)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())], ["lang", "feature", "n"])

    return sample.mapInArrow(run, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, held_out, per_lang: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    ship(docs.sparkSession)
    # BUCKETS rows per language at most
    rows = count_features(training_sample(docs, held_out, per_lang, id_col, text_col, lang_col)).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + OTHER + 1), np.int64)
    counts[rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64), rows["feature"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return Model(langs, counts)


def _one_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Languages of the words of one text."""
    n, k = scores.shape
    best, rows = scores[0].tolist(), scores.tolist()
    came: list[tuple[int, list[bool]]] = []
    for t in range(1, n):
        top = max(best)
        change, at = top - switch, best.index(top)
        stay = [b >= change for b in best]
        best = [(b if s else change) + x for b, s, x in zip(best, stay, rows[t])]
        came.append((at, stay))
    out = np.empty(n, np.int64)
    now = best.index(max(best))
    out[-1] = now
    for t in range(n - 2, -1, -1):
        at, stay = came[t]
        if not stay[now]:
            now = at
        out[t] = now
    return out


def paths(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi languages of the words of many texts that stand one after another, decoded side by side."""
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(len(scores), np.int64)
    for i in np.flatnonzero(lengths > LONG):
        part = slice(starts[i], starts[i] + lengths[i])
        out[part] = _one_path(scores[part], switch)
    order = np.argsort(-lengths, kind="stable")
    order = order[(lengths[order] <= LONG) & (lengths[order] > 0)]
    if not len(order):
        return out
    starts, lengths = starts[order], lengths[order]
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts that have a word t
    best = scores[starts].copy()
    stay, top_at = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int64)
    for t in range(1, longest):
        a = alive[t]
        at, b = starts[:a] + t, best[:a]
        top = b.argmax(axis=1)
        change = b[np.arange(a), top][:, None] - switch
        keep = b >= change
        stay[at], top_at[at] = keep, top
        best[:a] = np.where(keep, b, change) + scores[at]
    now = best.argmax(axis=1)
    out[starts + lengths - 1] = now
    for t in range(longest - 1, 0, -1):
        a = alive[t]
        at, n = starts[:a] + t, now[:a]
        now[:a] = np.where(stay[at, n], n, top_at[at])
        out[at - 1] = now[:a]
    return out


class Labeller:
    """Labels of texts with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.at = model, {}
        self.table, self.size = np.zeros((1024, max(1, len(model.langs))), np.float32), 0

    def _indices(self, words: list[str]) -> list[int]:
        new = set(filterfalse(self.at.__contains__, words))
        if new:
            if self.size + len(new) > WORDS:
                self.at.clear()
                self.size, new = 0, set(words)
            if self.size + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), self.size + len(new)), self.table.shape[1]), np.float32)
                grown[: self.size] = self.table[: self.size]
                self.table = grown
            fresh = list(new)
            self.table[self.size : self.size + len(fresh)] = self.model.scores(fresh)
            self.at.update(zip(fresh, range(self.size, self.size + len(fresh))))
            self.size += len(fresh)
        return list(map(self.at.__getitem__, words))

    def words(self, texts: list[str | None]) -> list[list[str]]:
        found = [WORD.findall(t) if t else [] for t in texts]
        # other alphanumeric signs, such as Roman numerals, are no letters
        return [ws if not ws or all(map(str.isalpha, ws)) else [w for w in ws if any(map(str.isalpha, w))] for ws in found]

    def label(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words = self.words(texts)
        if not self.model.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        lengths = np.array([len(ws) for ws in words], np.int64)
        flat = [w for ws in words for w in ws]
        at = self._indices(flat)
        path = paths(self.table[at], lengths)
        k = len(self.model.langs)
        letters = np.fromiter(map(len, flat), np.float64, len(flat))
        share = np.bincount(np.repeat(np.arange(len(words)), lengths) * k + path, weights=letters, minlength=k * len(words)).reshape(-1, k)
        total = share.sum(axis=1)
        best = share.argmax(axis=1)
        return [self.model.langs[b] if t else "und" for b, t in zip(best, total)], [float(share[i, b] / t) if t else 0.0 for i, (b, t) in enumerate(zip(best, total))]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, language) of the stretches of one language, by code points."""
        found = [m for m in WORD.finditer(text or "") if any(map(str.isalpha, m[0]))]
        if not found or not self.model.langs:
            return []
        at = self._indices([m[0] for m in found])
        path = paths(self.table[at], np.array([len(found)]))
        cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(found)]
        return [(found[a].start(), found[b - 1].end(), self.model.langs[path[a]]) for a, b in zip(cut, cut[1:])]


def labeller(model: Model) -> Labeller:
    """One per worker process and model, so that words learned in a task serve the next."""
    return held(("language", model.name), lambda: Labeller(model))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (and spans) of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS floats per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(shared.value)
        for batch in batches:
            for part in portions(batch):
                texts = part.column("text").to_pylist()
                langs, scores = own.label(texts)
                columns, names = [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
                if with_spans:
                    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
                    columns.append(pa.array([[{"start": a, "end": b, "lang": x} for a, b, x in own.spans(t)] for t in texts], kind))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(columns, names)

    more = ", spans array<struct<start: long, end: long, lang: string>>" if with_spans else ""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double" + more)


def keep_identified(docs: DataFrame, model: Model, min_share: float, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows whose text has no letter or no language with ``min_share`` of its letters."""
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = labeller(shared.value)
        for batch in batches:
            for part in portions(batch, text_col):
                langs, scores = own.label(part.column(at).to_pylist())
                yield part.filter(pa.array([x != "und" and s >= min_share for x, s in zip(langs, scores)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def third(id_col: str = "doc_id"):
    """Whether an id's crc32 leaves 1 by 3: the rows held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))
