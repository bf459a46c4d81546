import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, h long, shard_id string, word string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text, lang, source) rows, with extra columns whose names the operators also use inside."""

    def build(rows):
        full = [(r + (None,) * 4)[:4] for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or ""), "x", 1, "y", "z") for r in full], SCHEMA)

    return build
