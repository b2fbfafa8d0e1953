import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, payload binary, words string, x_text string, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text[, lang[, source]]), with further columns whose names clash with those that
    operators use inside."""

    def make(*rows):
        filled = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, b"p", "w", "x", "l") for i, t, lang, s in filled], DOCS)

    return make
