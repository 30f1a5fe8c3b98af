import pytest

SF = "/root/testdata/sf0.001"
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, slot int, node long, rows long, block int, digest string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, clashing column names."""
    words = " ".join(f"w{i}" for i in range(60))
    texts = [
        (1, words), (2, words), (2, words), (3, None), (4, ""), (5, "   \n\t"), (6, "one two"), (7, "one  two"), (None, words), (None, None),
        (8, "long " * 30000 + "a@b.co token = \"abcdef123456\""), (9, "x" * 70000), (10, words + " tail"), (11, "9" * 5000 + " 1.2.3.4"), (12, "é" * 10 + " <|endoftext|> Σς İ"),
    ]
    rows = [(i, t, None if i == 3 else "en", None, None if t is None else len(t), True, 0.5, 1, 2, 3, 4, "d") for i, t in texts]
    return spark.createDataFrame(rows, ODD_SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
