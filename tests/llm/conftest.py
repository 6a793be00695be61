import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with those that operators add.
CLASH = ", kept boolean, slot int, key string, length long, rank long, component_id string"


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice("the a of and river stone light house green walk quick over under town bread water field".split()) + draw.choice(["", "s", "ed"]) for _ in range(words))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, "the same text of some few words here", "en", "a", 36),
        (2, "the same text of some few words here", "en", "a", 36),
        (2, "the same text of some few words here", "en", "a", 36),
        (3, "", "fr", "b", 0),
        (4, None, None, None, None),
        (None, "the same text of some few words here", "en", None, 36),
        (None, None, None, None, None),
        (5, " \n\t ", "zz9", "b", 4),
        (6, long, "en", "a", len(long)),
        (7, long + " end", "en", "c", len(long) + 4),
        (8, "one two", "en", "c", 7),
        (9, "x" * 50_000, "en", "c", 50_000),
        (10, "naïve \U0001f600 café ßtraße " * 20, "de", "c", 500),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def odd_clash(spark):
    return spark.createDataFrame([(*r, True, 1, "k", 2, 3, "c") for r in odd_rows()], SCHEMA + CLASH)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]
