import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with the other columns filled in."""

    def make(rows, partitions=3):
        full = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return df.repartition(partitions)

    return make
