"""Shared rows that are hard to handle."""

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " kind string, start string, size string, n string, hash string, shard string, copies string,"
    " host string, path string, x string, e string, score string, first string, component string"
)
#: Extra columns with names that operators use inside.
EXTRA = ("?",) * 14


def rows(texts):
    """Documents with ids from 0, two sources, two languages."""
    return [(i, t, ("en", "de")[i % 2], f"s{i % 3 % 2}", len(t or ""), *EXTRA) for i, t in enumerate(texts)]


LONG = "lorem ipsum dolor sit amet " * 30_000
EDGE = [
    (0, None, "en", "s0", None, *EXTRA),
    (1, "", None, "s0", 0, *EXTRA),
    (2, " \t\n ", "en", None, 4, *EXTRA),
    (3, "one two", "en", None, 7, *EXTRA),
    (4, LONG, "en", "s1", len(LONG), *EXTRA),
    (5, "ONE  two", "de", "s1", 8, *EXTRA),
    (6, "ünï çødé \U0001f600 wörds in á row of nine", "de", "s1", 30, *EXTRA),
    (6, "ünï çødé \U0001f600 wörds in á row of nine", "de", "s1", 30, *EXTRA),
    (None, "a row without an id but with a text", "en", "s1", 35, *EXTRA),
    (None, None, None, None, None, *EXTRA),
    (7, "x" * 50_000, "en", "s1", 50_000, *EXTRA),
]


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge rows as a table of several files."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(EDGE, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def documents(spark, tmp_path):
    """Texts as a table of documents."""

    def make(texts, name="documents"):
        path = str(tmp_path / name)
        spark.createDataFrame(rows(texts), SCHEMA).write.parquet(path)
        return spark.read.parquet(path)

    return make
