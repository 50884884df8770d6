import pytest


@pytest.fixture(scope="session")
def docs_rows():
    """Documents with every awkward case: null, empty, blank, ties, copies, long, odd characters, repeated rows."""
    words = [f"w{i}" for i in range(400)]
    a, b = " ".join(words[:120]), " ".join(words[200:330])
    near = a.replace("w7 ", "x7 ").replace("w60 ", "x60 ")
    long = " ".join(f"t{i % 977}x{i % 31}" for i in range(30_000))
    rows = [
        (1, None), (2, ""), (3, " \n\t "), (4, a), (5, a), (6, near), (7, a.upper()), (8, b + " " + a[:300]), (9, b), (10, "one two three"), (11, "one two three"),
        (12, "ONE two\tthree"), (13, long), (14, "naïve café 　 <|endoftext|> x\x85y  z\n\nq ▁u"), (15, " ".join(words[:60]) + " " + " ".join(words[:60])), (16, b.replace("w210", "zz")), (17, long[: len(long) // 2]),
        (4, a),
    ]
    return [(i, t, "en", None if i == 9 else f"src{i % 3}", len(t or ""), "extra") for i, t in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def docs(spark, docs_rows):
    return spark.createDataFrame(docs_rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
