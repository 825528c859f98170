import pytest

LONG = "word " * 30_000 + "😀é " * 2000
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog. Mail joe.doe@mail.example.com or call +1 (555) 555-1234."),
    (1, None),
    (2, ""),
    (3, LONG),
    (4, "   \n\t  "),
    (None, "A text without an id."),
    (5, "Repeated row, twice the same id and text."),
    (5, "Repeated row, twice the same id and text."),
    (6, "1234 5678 !!! 12.34"),
    (7, "Un deux trois quatre cinq, le chat est dans la maison et il dort."),
    (8, "The quick brown fox jumps over the lazy dog. Mail joe.doe@mail.example.com or call +1 (555) 555-1234."),
    (9, "é ▁ <s> <|endoftext|> \x00 가 ñ 🙂"),
]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", "src", len(t) if t is not None else None, "x", 1, "y", "z", 2) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, fp int, hash string, ids string, counts int").repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
