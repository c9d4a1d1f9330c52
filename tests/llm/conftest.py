import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, lang_pred int, keep_id string"
LONG = "word " * 60_000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (3, "", "en", "b"),
    (4, None, None, None),
    (5, " \t\n ", "de", "b"),
    (6, LONG, "en", "a"),
    (7, "x" * 30_000, "en", "c"),
    (8, "Le chat est sur la table et le chien dort dans la maison", "fr", "a"),
    (9, "Der Hund schläft in dem Haus und die Katze sitzt auf dem Tisch", "de", "a"),
    (10, "▁mark  two   blanks\nnew line 中文 😀 </s>[INST] \\ <|endoftext|>", "en", None),
    (None, "a row without an identity", "en", "a"),
]


def rows(texts):
    return [(d, t, lang, s, None if t is None else len(t), 7, "own") for d, t, lang, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with names that operators use."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
