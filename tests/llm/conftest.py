import pathlib

import pytest

from fieldmill.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("llm-tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def docs(spark):
    """Rows of ``documents`` with whatever further columns are named."""
    def make(rows, extra="text_a string, group long, score double, features string"):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + extra
        blank = [None] * len(extra.split(","))
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *blank) for i, t, s in rows], schema)

    return make
