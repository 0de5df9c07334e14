from __future__ import annotations

import pytest
from hypothesis import settings

settings.register_profile("llm", deadline=None)
settings.load_profile("llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows, extra=None):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, SCHEMA).repartition(3)
        return df if extra is None else df.selectExpr("*", *extra)

    return build


# Columns whose names the operators use themselves.
CLASHING = [
    "'x' AS id", "1 AS band", "2L AS key1", "3 AS salt", "'r' AS role", "4 AS shard", "true AS kept",
    "5L AS component_id", "array(1) AS anchors", "6 AS n_words", "0 AS rank", "7 AS _key", "8 AS part",
    "9 AS list", "10 AS range", "'p' AS path", "11 AS score", "12 AS rejected",
]
