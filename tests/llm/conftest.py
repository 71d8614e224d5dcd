import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of ``doc_id, text, lang, source, n_chars`` from pairs or triples."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make
