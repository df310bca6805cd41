import pytest

# Column names that operators use inside, to see that they do not clash.
CLASHING = ["_key", "_id", "seed", "words", "n", "node", "score", "tokens", "size", "copies", "marks", "lines", "kept"]

PASSAGE = " ".join(f"passage{i}" for i in range(60))
PROSE = " ".join(f"word{i * 7 % 101}x{i}" for i in range(80))
LONG = " ".join(f"long{i}" for i in range(30_000))


def edge_rows():
    texts = [
        (1, PASSAGE + " one ending"),
        (2, "another start " + PASSAGE),
        (3, None),
        (4, ""),
        (5, " \t\n\r "),
        (6, "one two three"),
        (7, LONG),
        (8, PROSE + " " + LONG[:2000]),
        (9, PROSE),
        (9, PROSE),
        (None, PROSE + " tail"),
        (None, None),
        (10, "a b " * 300),
        (11, "été 你好 \U0001f600 naïve слово x"),
    ]
    return [(i, t, "en" if i and i % 2 else None, f"src{i % 3}" if i else None, len(t or "")) for i, t in texts]


@pytest.fixture(scope="session")
def edge_docs(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(edge_rows(), schema)
    return docs.selectExpr("*", *[f"'clash' AS {c}" for c in CLASHING])


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
