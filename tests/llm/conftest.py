import pytest


def frame(spark, rows, extra=True):
    """documents(doc_id, text, lang, source, n_chars) of (doc_id, text[, source]) rows, with columns whose names operators use themselves."""
    rows = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for name in ("id", "key", "n", "rep", "ka", "kb", "spans", "wanted", "host", "path", "kind", "good", "size", "target", "w", "h1", "block", "part"):
            docs = docs.selectExpr("*", f"doc_id * 7 AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows, extra=True: frame(spark, rows, extra)


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def messy():
    """Rows with null ids and texts, empty and blank texts, repeated rows, a very long text and its copy."""
    return [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n "), (None, "a b c d e f g"), (None, None),
            (5, LONG), (6, LONG + " end"), (7, "a b"), (8, "A B"), (9, "é ü ñ \U0001F600 x\x00y")]
