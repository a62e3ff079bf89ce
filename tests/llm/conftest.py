import pytest

EXTRA = "lang string, source string, n_chars long, block string, doc_ids int, spans string, mix_key double, label long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns whose names the operators use inside."""

    def make(rows, partitions=3, **columns):
        full = [(d, t, columns.get("lang", {}).get(d), columns.get("source", {}).get(d), None, "x", 1, "y", 0.5, 7) for d, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, " + EXTRA).repartition(partitions)

    return make
