"""Small documents with every odd case."""

import pytest

LONG = " ".join(f"word{k % 977} and the {k}" for k in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and clashing extra columns."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog for a while", "en", "src0", 1, "x", 0.5),
        (1, "the cat sat on the mat and looked at the dog for a while", "en", "src0", 1, "x", 0.5),
        (2, None, "en", None, None, None, None),
        (3, "", None, "src1", 0, "", 0.0),
        (None, "le chat est sur la table avec le chien et les enfants", "fr", "src2", 5, "y", 1.0),
        (4, LONG, "en", "src0", len(LONG), "z", 2.0),
        (5, "  \n\t ", "fr", "src3", 5, "z", 2.0),
        (6, "naïve café 東京 <|endoftext|> x", None, "src3", 5, "z", 2.0),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, score double"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
