from __future__ import annotations

from datetime import date

import pytest

from tallyloom.model import TABLES
from tallyloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """``make("orders", (1, "2024-01-05", 7, None, "Completed"), ...)``: a model table."""

    def build(name: str, *rows):
        spec = TABLES[name]
        text = spark.createDataFrame(
            [tuple(None if v is None else str(v) for v in row) for row in rows],
            ", ".join(f"{c} string" for c in spec.column_names),
        )
        return text.select(*(text[c].cast(t).alias(c) for c, t in spec.columns))

    return build


def rows(df, *columns):
    """Rows as tuples, in the frame's order."""
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def day(text: str) -> date:
    return date.fromisoformat(text)
