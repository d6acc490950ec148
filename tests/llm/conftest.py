from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """``docs_of([(doc_id, text), ...])``: a documents table with a clashing extra column."""

    def build(rows, parts: int = 2):
        frame = spark.createDataFrame(
            [(i, t, "x", 7) for i, t in rows], "doc_id long, text string, node string, component_id int"
        )
        return frame.repartition(parts)

    return build
