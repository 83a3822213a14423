import pytest


@pytest.fixture
def docs(spark):
    """Rows (doc_id, text, ...) as a table like ``documents``."""

    def make(rows, extra="lang string, source string, n_chars long"):
        names = [x.split()[0] for x in extra.split(",")] if extra else []
        rows = [tuple(r) + (None,) * (2 + len(names) - len(r)) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string" + (f", {extra}" if extra else ""))

    return make
