import os

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, source]) rows, with a column that clashes with result names."""
    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), 7, "x", *"abcdefgh") for r in rows]
        return spark.createDataFrame(full, DOCS + ", size long, label string, _w string, _h string, _id string, _t string, _all string, "
                                                  "node string, key string, _copy string")
    return make
