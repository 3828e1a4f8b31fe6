import os

import pytest

SF = os.path.join(os.environ.get("TESTDATA_DIR", "/root/testdata"), "sf0.001")
DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def corpus(documents):
    """(doc_id, text) of the test documents, and awkward ones."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    long = " ".join(t for _, t in rows[:40] if t)
    odd = [None, "", " \n\t", "a", "Ünï çödé 漢字 🙂", "\x00\x1c\x85", "one two three four", "one two three four", long, long + " end"]
    return rows + [(10_000 + i, t) for i, t in enumerate(odd)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use themselves."""
    rows = [(i, t, "x", 1, True) for i, t in corpus]
    return spark.createDataFrame(rows, DOCS + ", hash string, row int, kept boolean").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS + ", lang string, source string, n_chars bigint")
