import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven bright stars shine above quiet hills and rivers".split()


@pytest.fixture
def sentence():
    pick = random.Random(5)
    return lambda n: " ".join(pick.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with columns whose names operators also use."""

    def made(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, score string, fp string, id string, n long"
        return spark.createDataFrame([(i, t, None, "s", None, "x", "y", "z", 3) for i, t in rows], schema)

    return made
