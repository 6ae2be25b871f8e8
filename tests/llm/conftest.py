import pytest

ODD = [
    (1, "", "en", "a", 0), (2, None, None, None, None), (3, "one two", "en", "a", 7), (4, "x " * 20000, "en", "b", 40000), (5, "Alpha beta gamma delta epsilon zeta", "en", "b", 35),
    (6, "Alpha  beta\tgamma delta epsilon zeta", "en", "b", 36), (7, "alpha beta gamma delta epsilon zeta", "de", "c", 35), (7, "alpha beta gamma delta epsilon zeta", "de", "c", 35),
    (None, "Alpha beta gamma delta epsilon zeta", "en", "c", 35), (8, "é ß \x01 <|endoftext|> 中文 tail", None, "c", 20), (9, "\n\n  \n", "en", None, 5),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like outputs."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, SCHEMA)
    clashing = "target source_size copies common text_sha256 component_id group_size n_words spans mark none least length words".split()
    rows = rows.withColumns({c: F.lit("y") for c in clashing})
    return rows.withColumn("kept", F.lit("mine")).withColumn("size", F.lit(1)).withColumn("id", F.lit("x")).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
