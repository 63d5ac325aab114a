import pytest
from pyspark import cloudpickle

import symptia

cloudpickle.register_pickle_by_value(symptia)

EDGES = [(1, None), (2, ""), (3, " \n"), (4, "x"), (None, "no id here"), (5, "twice the same"), (5, "twice the same"),
         (6, "Ünï çödé 漢字 😀"), (7, "long " * 40_000), (8, "A" * 30_000)]


@pytest.fixture(scope="session")
def docs(spark):
    """A table like ``documents`` with extra columns whose names operators use
    themselves."""

    def make(rows):
        rows = [(i, t, f"row{k}", k, True) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, row string, place long, kept boolean")

    return make


@pytest.fixture(scope="session")
def edges(docs):
    return docs(EDGES)
