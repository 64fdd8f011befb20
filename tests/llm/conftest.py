from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Builds documents from (doc_id, text) or (doc_id, text, lang)."""

    def build(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        out = spark.createDataFrame(full, DOCS)
        if extra:  # columns whose names operators use inside
            from pyspark.sql import functions as F

            out = out.withColumns({c: F.lit("x") for c in ("key", "id", "n", "component_id", "kept", "score", "name", "block", "h", "comp", "w")})
        return out

    return build
