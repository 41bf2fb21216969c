from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators use inside."""
    def build(rows, source=None):
        data = [(i, t, None if i == 2 else "en", (source or (lambda k: f"s{(k or 0) % 2}"))(i), len(t or "")) for i, t in rows]
        return spark.createDataFrame(data, DOC)
    return build


@pytest.fixture(scope="session")
def odd(make, spark):
    """Null and empty texts, a null id, a repeated row, white space only, a long text, and clashing extra columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "alone here"), (4, "same row twice"), (4, "same row twice"), (5, "long word " * 30_000)]
    df = make(rows)
    for c in ("node", "rid", "key", "th", "size", "_size", "score", "n_lines", "row", "bucket", "from"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    return df
