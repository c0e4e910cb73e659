import random

import pytest

ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "a",
    "one two three four",
    "One two THREE four five",
    "one two three four five",
    "ünï ½ 日本語 \x1c\x1f \x85 \U0001f600 end",
    "x@y.zz; +1 (555) 555-1234; 4111 1111 1111 1111; 10.0.0.1",
    "word " * 3000,
    "".join(random.Random(1).choices("abcdefghij ", k=5000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, text, None, "s", 0.5, 1, "x", [1]) for i, text in enumerate(ODD_TEXTS)]
    rows += [rows[6], rows[9], (None, "text without an id", "en", None, None, None, None, None)]
    rows += [(7, "another text under the same id", "en", "s", None, 1, "x", [2])]
    schema = (
        "doc_id long, text string, lang string, source string, score double, predicted int,"
        " _row string, keys array<int>"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 1), (3, None, None), (4, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture()
def rng():
    return random.Random(5)
