import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over the lazy dog while seven other animals watch from a quiet hill near the old mill pond today"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, PROSE, "en", "src0", 10),
        (2, None, "en", "src0", None),
        (3, "", None, None, 0),
        (None, PROSE + " again", "de", None, 5),
        (5, None, None, None, None),
        (6, PROSE, "en", "src0", 10),
        (6, PROSE, "en", "src0", 10),
        (7, " \t\n\x0b\f\r", "fr", "src1", 6),
        (8, " ".join(f"w{i % 977}x{i}" for i in range(30_000)), "en", "src1", 1),
        (9, "line one is here and it is long enough to count\n" * 50, "en", "src1", 1),
        (10, "é ü 漢字 \U0001f600 ok", "es", "src2", 1),
        (11, "7" * 60_000 + " " + "a" * 60_000, "en", "src2", 1),
    ]
    df = spark.createDataFrame(rows, DOC)
    return df.selectExpr("*", "doc_id AS __d", "text AS kept", "1 AS n_words", "'x' AS spans", "0 AS epoch", "source AS u", "lang AS fp")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
