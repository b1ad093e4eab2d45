import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty, one-word and long texts, ties, and repeated rows."""
    long = " ".join(f"word{i % 977} of the matter" for i in range(6000))
    rows = [
        (1, "the cat and the dog are in the house of the man", "en", "a", 1),
        (1, "the cat and the dog are in the house of the man", "en", "a", 1),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "le chat et le chien sont dans la maison", "fr", "a", 2),
        (4, "le chat et le chien sont dans la maison de la rue", "fr", None, 3),
        (5, long, "en", "a", 4),
        (6, long + " tail", "en", "b", 5),
        (7, "12345 !!! 678", "en", "b", 6),
        (8, "chat", "fr", "b", 7),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named like those that operators make."""
    names = ["rid", "id", "fp", "key", "deleted", "n_lines", "leaks", "kept", "host", "size", "rate", "chunk", "lang_pred", "n_entities", "e", "kind", "path", "rank"]
    return docs.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
