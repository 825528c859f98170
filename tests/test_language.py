"""Vectorised language scores are those of the plain definition."""

import random

import pytest
import regex

from pageflow.functions import language

LANGS = ["a", "b", "c"]


def plain_trigrams(word):
    return [f" {word} "[i : i + 3] for i in range(len(word))]


def plain_best(text, table):
    total, known = [0.0] * len(LANGS), False
    for w in regex.findall(r"\p{L}+", (text or "").lower()):
        score = [sum(table.get(g, [0.0] * len(LANGS))[k] for g in plain_trigrams(w)) for k in range(len(LANGS))]
        total, known = [x + y for x, y in zip(total, score)], known or any(score)
    return max(zip(total, LANGS))[1] if known else None


@pytest.mark.parametrize("text", ["a²b ½ ⅷ x_y 12ab İ ſtráe 字12", "", "²", "plain words", "don't"])
def test_words(text):
    assert language.words_of(text) == regex.findall(r"\p{L}+", text.lower())


@pytest.mark.parametrize("words", [["abc", "é", "x"], ["字", "straße", "𝒳y"], []])
def test_trigrams(words):
    codes, letters = language.trigrams(words)
    assert [language.trigram_text(int(c)) for c in codes] == [g for w in words for g in plain_trigrams(w)]
    assert letters.tolist() == [len(w) for w in words]


def test_best_languages():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    # weights with many ties: exact sums, whatever their order
    tables = {k: {g: [r.choice([0.0, 1.0, 2.0, 3.5]) for _ in LANGS] for _ in range(30) for g in plain_trigrams(word())} for k in (0, 1)}
    texts = [None, "", "12", *(" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(2000)), "zzz"]
    folds = [r.randint(0, 1) for _ in texts]
    scorers = {k: language.Scorer(LANGS, t) for k, t in tables.items()}
    assert language.best_languages(texts, folds, scorers) == [plain_best(t, tables[k]) for t, k in zip(texts, folds)]
    assert language.best_languages(["ab", None], [0, 0], {0: language.Scorer([], {})}) == [None, None]
    assert language.best_languages([], [], scorers) == []


def test_counts(spark):
    rows = [("aba aba", "x", 0), ("aba ü", "x", 0), ("aba", "y", 1), (None, "x", 0), ("c", None, 0), ("", "x", 1)]
    got = {(r.fold, r.lang, r.gram): r.n for r in language.count_trigrams(spark.createDataFrame(rows, "text string, lang string, fold int")).collect()}
    assert got == {(0, "x", " ab"): 3, (0, "x", "aba"): 3, (0, "x", "ba "): 3, (0, "x", " ü "): 1, (1, "y", " ab"): 1, (1, "y", "aba"): 1, (1, "y", "ba "): 1}


def test_scripts(spark):
    texts = ["안녕", "ひらがな 漢字", "漢字", "Привет", "مرحبا", "ไทย", "plain ü – ‘x’", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.s for r in rows.select("i", language.by_script(rows.t).alias("s")).orderBy("i").collect()]
    assert got == ["ko", "ja", "zh", "ru", "ar", "th", None, None, None]
