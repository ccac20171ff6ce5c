import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


def documents(spark, rows):
    """Rows (doc_id, text, lang, source) as a documents table with clashing further columns."""
    data = [(*r, None if r[1] is None else len(r[1]), 1, "x") for r in rows]
    return spark.createDataFrame(data, DOC_SCHEMA + ", n_words long, score string")


#: Nulls in every column, empty and very long texts, repeated rows.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \n\t ", "en", "a"),
    (4, "one", None, "a"),
    (5, "one two three four", "en", None),
    (6, "one two three four", "en", None),
    (7, "one two three four five six seven eight nine ten eleven twelve", "en", "b"),
    (7, "one two three four five six seven eight nine ten eleven twelve", "en", "b"),
    (8, "été ñandú über 東京 Москва 12345 \U0001f600 ###", "xx", "b"),
    (9, "word " * 60_000, "en", "c"),
    (10, "a b c d e f g h i j\n" * 3, "en", "c"),
]


def odd_vectors(spark):
    """Vectors of few directions with copies and ties, nulls in every column, wrong lengths, and clashing further columns."""
    nan, inf = float("nan"), float("inf")

    def vector(k):
        return [((k * (d + 3)) % 11 - 5) / 16 + (d == k % 64) / 4 for d in range(64)]

    rows = [(k, vector(k % 90), k % 10) for k in range(300)]
    rows += [(50, vector(7), 3), (50, vector(7), 3), (350, vector(1), None), (None, vector(2), 2), (400, None, 1), (401, [], 1), (402, [0.5] * 63, 1)]
    rows += [(403, [0.0] * 64, 1), (450, [0.0] * 64, 4), (404, [None] + [0.5] * 63, 1), (405, [nan] * 64, 1), (500, [inf] * 64, 2), (None, None, None)]
    return spark.createDataFrame([(*r, 1, "x", 7) for r in rows], "vec_id long, embedding array<float>, label int, x int, cluster string, anchor int")
