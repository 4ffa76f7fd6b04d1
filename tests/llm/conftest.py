from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
