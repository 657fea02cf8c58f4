import pytest

EXTRA = ("size", "shard", "row", "counts", "kept", "fp", "lang_pred", "score", "place", "block", "rank", "copies", "target", "bin", "p", "hash", "id", "vec", "url_key", "original", "decoded", "ids", "label")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def with_extra(df):
    """Columns that operators do not ask for, named like some they might use inside."""
    return df.selectExpr("*", *[f"'x' AS {c}" for c in EXTRA if c not in df.columns])


ODD = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n", None, "a", 3), (4, "One two three four five.", "en", None, 5), (4, "One two three four five.", "en", None, 5),
    (None, "One two three four five.", "en", "b", 5), (None, None, None, None, None), (5, "12 34 ### !!", "en", "a", 1), (6, "word " * 200_000, "en", "a", 1),
    (7, "\u00c9t\u00e9 \U0001f600\u00a0x\u2003y\x1cz \x85", "fr", "b", 1), (8, "one TWO Three\nfour  five.", "en", "a", 1), (9, "x" * 50_000, "de", "b", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    return with_extra(spark.createDataFrame(ODD, DOCUMENT)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return with_extra(spark.createDataFrame([], DOCUMENT))


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return documents.collect()
