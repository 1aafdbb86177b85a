import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table from texts or (doc_id, text, lang, source) rows."""

    def make(*rows):
        rows = [(i, x, "en", "s") if isinstance(x, str) or x is None else x for i, x in enumerate(rows)]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCUMENTS)

    return make
