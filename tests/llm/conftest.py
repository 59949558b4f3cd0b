import random

import pytest

WORDS = [a + b for a in "ka lo mi nu ri so ta ve wo xi".split() for b in "ba de fi go hu".split()]


@pytest.fixture(scope="session")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture
def prose():
    r = random.Random(11)
    return lambda n: " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture
def documents(spark):
    """A table of documents with columns that clash with names operators use, and odd rows."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, ids string, node string, host string, rows string, lines string, __text string, __hash string"
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), "s", "i", "n", "h", "r", "l", "t", "#") for d, t, s in rows], schema)

    return make


ODD = [(None, "no id", "s"), (900, None, "s"), (901, "", "s"), (902, "   \n\n ", None), (903, "x" * 50_000, "s"), (904, "one two", "s"), (904, "one two", "s"), (None, None, None)]
