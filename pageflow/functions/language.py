"""Language of a text from character trigrams, with script ranges first; models come from labelled rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageflow.session import portions, ship

# Scripts that one language stands for here.
SCRIPTS = [("\\p{IsHangul}", "ko"), ("[\\p{IsHiragana}\\p{IsKatakana}]", "ja"), ("\\p{IsHan}", "zh"), ("\\p{IsCyrillic}", "ru"), ("\\p{IsArabic}", "ar"), ("\\p{IsThai}", "th")]

#: Trigrams kept for each language; languages that a model may have; weight of a trigram that a profile lacks.
PROFILE, LANGUAGES, FLOOR = 400, 256, -12.0
#: Bytes of text that a task holds at once, about.
PORTION = 4_000_000

#: Weights by trigram and language, for each fold.
Profiles = dict[int, tuple[list[str], dict[str, list[float]]]]


def by_script(text: Column) -> Column:
    """The language of the first script in the list that the text has; null for others. All of them lie from U+0400 on, so one
    look at a text mostly settles it."""
    out = F
    for pattern, lang in SCRIPTS:
        out = out.when(text.rlike(pattern), lang)
    return F.when(text.rlike("[\\x{400}-\\x{10FFFF}]"), out.otherwise(None))


_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    words = _RUN.findall(text.lower())
    if "".join(words).isalpha():
        return words
    # a run may hold numbers that are no decimal digits
    return [w for run in words for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of words with their ends marked, as numbers of three code points of 21 bits, one for each letter; letters of each word."""
    letters = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.arange(letters.sum()) + np.repeat(2 * np.arange(len(words)), letters)  # two marks a word
    return points[at] << 42 | points[at + 1] << 21 | points[at + 2], letters


def trigram_text(code: int) -> str:
    return "".join(chr(code >> k & 0x1FFFFF) for k in (42, 21, 0))


def count_trigrams(labelled: DataFrame) -> DataFrame:
    """fold, lang, gram, n of rows with text, lang and fold. Each task adds up a portion of texts before anything is shuffled."""
    ship(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, "text", PORTION):
                words: dict[tuple, list[str]] = {}
                for text, lang, fold in zip(*(part.column(c).to_pylist() for c in ("text", "lang", "fold"))):
                    words.setdefault((fold, lang), []).extend(words_of(text))
                rows = []
                for key, found in words.items():
                    distinct = pa.array(found, pa.string()).value_counts()
                    codes, letters = trigrams(distinct.field("values").to_pylist())
                    grams, at = np.unique(codes, return_inverse=True)
                    counts = np.bincount(at, np.repeat(distinct.field("counts").to_numpy(), letters), len(grams))
                    rows += [(*key, trigram_text(g), int(n)) for g, n in zip(grams.tolist(), counts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["fold", "lang", "gram", "n"])

    usable = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.col("fold").cast("int").alias("fold"))
    return usable.mapInArrow(run, "fold int, lang string, gram string, n long").groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n"))


def profiles(labelled: DataFrame, folds: list[int], keep: int = PROFILE) -> Profiles:
    """For each fold, the most frequent trigrams of each language in the other folds, by log share: ``keep`` a language.

    Counts are aggregated before languages are ranked, so a language of most rows is no long partition. More than
    LANGUAGES languages raise an error; with that, what comes to the driver is bounded.
    """
    counts = count_trigrams(labelled)
    of = F.explode(F.array(*(F.lit(k) for k in folds)))
    others = counts.withColumn("of", of).where("fold <> of or fold is null").groupBy("of", "lang", "gram").agg(F.sum("n").alias("n"))
    top = F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), asc=False), 1, keep)
    ranked = others.groupBy("of", "lang").agg(top.alias("top"), F.sum("n").alias("total"))
    rows = ranked.select("of", "lang", F.transform("top", lambda t: F.struct(t["gram"].alias("gram"), F.log(t["n"] / F.col("total")).alias("weight"))).alias("top")).limit(len(folds) * LANGUAGES + 1).collect()
    if len(rows) > len(folds) * LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages are labelled")
    out: Profiles = {}
    for fold in folds:
        own = sorted((r for r in rows if r["of"] == fold), key=lambda r: r["lang"])
        table: dict[str, list[float]] = {}
        for k, r in enumerate(own):
            for g in r["top"]:
                table.setdefault(g["gram"], [0.0] * len(own))[k] = g["weight"] - FLOOR
        out[fold] = [r["lang"] for r in own], table
    return out


class Scorer:
    """One fold's profiles: trigrams in order, with a row of weights for each; the last row is of all others."""

    def __init__(self, langs: list[str], table: dict[str, list[float]]):
        codes = np.array([sum(ord(c) << k for c, k in zip(g, (42, 21, 0))) for g in table], np.int64)
        order = np.argsort(codes)
        self.langs, self.codes = langs, codes[order]
        self.weights = np.zeros((len(table) + 1, len(langs)))
        self.weights[:-1] = np.array([*table.values()]).reshape(len(table), len(langs))[order]

    def scores(self, codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Sums of weights of the trigrams of each word."""
        at = np.searchsorted(self.codes, codes)
        at[np.append(self.codes, -1)[at] != codes] = len(self.codes)
        return np.add.reduceat(self.weights[at], np.cumsum(letters) - letters)


def best_languages(texts: list[str | None], folds: list[int], scorers: dict[int, Scorer]) -> list[str | None]:
    """For each text, the language whose profile in its fold has the greatest sum of weights; of equals, the last by name; none if no
    trigram is known."""
    out: list[str | None] = [None] * len(texts)
    words: list[str] = []
    ends = []
    for t in texts:
        words += words_of(t) if t else []
        ends.append(len(words))
    if not words:
        return out
    coded = pa.array(words, pa.string()).dictionary_encode()
    codes, letters = trigrams(coded.dictionary.to_pylist())
    ids, ends, folds = coded.indices.to_numpy(), np.array(ends), np.array(folds)
    starts = np.concatenate([[0], ends[:-1]])
    for fold, scorer in scorers.items():
        mine = np.flatnonzero((folds == fold) & (ends > starts))
        if not len(mine) or not scorer.langs:
            continue
        scores = scorer.scores(codes, letters)
        known = (scores != 0).any(axis=1)
        own = np.concatenate([ids[starts[i] : ends[i]] for i in mine])
        heads = np.cumsum(ends[mine] - starts[mine]) - (ends[mine] - starts[mine])
        total = np.add.reduceat(scores[own], heads)
        last = len(scorer.langs) - 1 - total[:, ::-1].argmax(axis=1)
        for i, some, k in zip(mine, np.logical_or.reduceat(known[own], heads), last):
            out[i] = scorer.langs[k] if some else None
    return out


def detect(rows: DataFrame, model: Profiles, text: str = "text", fold: str | None = None) -> DataFrame:
    """rows with detected: by script, else the language whose profile fits best; empty, never null, if none does.

    Texts are scored in the task that reads them; nothing is shuffled. Null and empty texts are of no language.
    """
    spark = rows.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # PROFILE weights a language
    schema = T.StructType([*rows.schema.fields, T.StructField("_best", T.StringType())])
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {k: Scorer(*profile) for k, profile in shared.value.items()}
        only = next(iter(scorers))
        for batch in batches:
            for part in portions(batch, text, PORTION):
                folds = part.column(part.schema.get_field_index(fold)).to_pylist() if fold else [only] * part.num_rows
                best = best_languages(part.column(at).to_pylist(), folds, scorers)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.string())], [*part.schema.names, "_best"])

    return rows.mapInArrow(run, schema).withColumn("detected", F.coalesce(by_script(F.col(text)), F.col("_best"), F.lit(""))).drop("_best")


def other_language(rows: DataFrame, target: Column, detected: str = "detected") -> DataFrame:
    """Rows not yet in the target language; unknown ones stay."""
    return rows.where(F.coalesce(F.col(detected), F.lit("")) != target)
