"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "doc", "score", "rank"] and df.count() > 0


def test_every_oracle_has_a_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 140


def test_nothing_outside_imports_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for f in root.glob("lectern/**/*.py"):
        if "llm" not in f.parts:
            assert "lectern.llm" not in f.read_text() and "from .llm" not in f.read_text(), f
