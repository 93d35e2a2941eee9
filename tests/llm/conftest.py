import os

import pytest


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ.setdefault("PYTHONPATH", os.getcwd())
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled",
        "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


LONG = "lorem ipsum dolor sit amet " * 4000
#: doc_id, text, lang, source, n_chars and a column whose name clashes with internal ones.
AWKWARD = [
    (1, None, "en", "a", None, "x"), (2, "", "en", None, 0, "x"), (3, " \n\t ", None, "a", 3, "x"), (4, "short", "en", "a", 5, "x"), (5, "12345 !!", "en", "b", 8, "x"),
    (6, "one two three four five six seven eight nine ten " * 5, "en", "b", 250, "x"), (7, "one two three four five six seven eight nine ten " * 5, "en", "b", 250, "x"),
    (7, "one two three four five six seven eight nine ten " * 5, "en", "b", 250, "x"), (8, LONG, "la", "a", len(LONG), None),
    (9, "Größe und Straße für alle Leute hier", "de", "c", 36, "x"), (None, "no id at all but text", "en", "c", 20, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
