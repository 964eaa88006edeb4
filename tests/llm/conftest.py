import pytest

LONG = " ".join(f"word{k % 5000}x{k}" for k in range(20_000)) + "."
TEXTS = [
    (1, None), (2, ""), (3, " \t\n \r\n"), (4, "a"), (5, "a"), (6, "a b"), (7, LONG), (8, "é 中文 \U0001f600 ñandú\x00\x0b"),
    (9, "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen fifteen."),
    (10, "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen fifteen."),
    (None, "One two three four five. Six seven eight nine ten. Eleven twelve thirteen fourteen fifteen."),
    (11, "x" * 50_000), (12, "\n" * 1000), (12, "\n" * 1000),
]
#: Names that a careless operator might use for columns of its own.
CLASH = ["doc", "pos", "line", "h", "g", "k", "f", "i", "n", "e", "w", "chunk", "bucket", "kind", "value", "removed", "ranges", "lang", "source", "n_chars"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, long and repeated texts, a null id, and clashing columns, some of them null."""
    rows = [(i, t, *[None if (k + (i or 0)) % 3 == 0 else str(k) for k in range(len(CLASH))]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
