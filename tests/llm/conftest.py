import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; as columns of a table they must not matter.
CLASHES = ["row", "key", "id", "score", "kept", "size", "start", "n", "value", "cell", "grp", "gone", "may", "copies",
           "source_no", "order_key", "cut_source", "last_key", "epochs", "_len", "_full", "_place", "_bit_row", "_bit_set",
           "spans", "near", "term", "lo", "hi", "vector", "record", "digest", "_key", "at", "keep_id"]
LONG = "lorem " * 60_000 + "x" * 4_000 + " 1" * 30_000
TWIN = " ".join(f"word{i}" for i in range(60))

DOCUMENTS = [
    (1, "Alpha beta, gamma.", "en", "b"), (2, "alpha BETA, gamma.", "en", "b"), (3, None, "en", "a"), (4, "", "de", None),
    (5, TWIN, "fr", "a"), (6, TWIN.replace("word30", "other"), "fr", "a"), (7, LONG, "es", "c"), (8, LONG + "!", "es", None),
    (9, " \t\n ", None, "c"), (10, "vous êtes 𝄞 ici: jo.x@mail.example.org, +1 (555) 123-4567 et 4111 1111 1111 1111", "fr", "d"),
    (10, "vous êtes 𝄞 ici: jo.x@mail.example.org, +1 (555) 123-4567 et 4111 1111 1111 1111", "fr", "d"),
    (11, "one two three", None, None), (None, "null id", "en", "a"), (None, None, None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def with_clashes(df):
    return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES if c not in df.columns])


@pytest.fixture(scope="session")
def documents(spark):
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in DOCUMENTS], SCHEMA + ", n_chars bigint")
    return with_clashes(df).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA + ", n_chars bigint")


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 12)] + [(None, 1, 1), (5, None, None), (99, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")
