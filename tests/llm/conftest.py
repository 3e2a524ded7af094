import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " row string, uid string, score string, host string, kept string, fp string, key string,"
    " class string, n string, candidates string"
)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeats, clashing columns."""
    rng = random.Random(7)
    words = ["alpha", "beta", "the", "of", "gamma", "delta", "house", "river", "é1", "x@y.z", "12", "🙂"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 160))) for _ in range(30)]
    texts = [None, "", " \n\t ", "one", "a" * 40_000, long, "<|endoftext|> x", *prose, prose[0], prose[0]]
    rows = [
        (i, t, rng.choice(["en", "de", None]), rng.choice(["s", None]), None if t is None else len(t))
        for i, t in enumerate(texts)
    ]
    rows += [(None, "null id", None, None, None), (None, None, None, None, None), rows[8], rows[8]]
    return [(*r, "r", None, "s", "h", "k", "f", "y", "c", "m", "d") for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, 1, int(i % 5 == 0)) for i in range(40)] + [(None, 0, 1), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
