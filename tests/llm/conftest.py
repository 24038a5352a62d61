import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, part int, digest string, count long, _id long, _rank double, node long, host string, raw string, key string, _set long, _gone long, _node long, _component long, _cluster long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, very long and repeated rows, and extra columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s", 5, 9, 9, "x"),
        (2, "", "en", "s", 0, None, None, None),
        (3, None, None, None, None, None, None, None),
        (None, "orphan text without an id", "en", None, 1, 1, 1, "y"),
        (4, "word " * 20000, "en", "s", 100000, 1, 1, "y"),
        (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s", 5, 9, 9, "x"),
        (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s", 5, 9, 9, "x"),
        (6, "naïve  Ünïcode spaces and é İ ΑΣ don't 123 <|endoftext|>\n\n\ttabs", "fr", "t", 3, 1, 1, "z"),
    ]
    return spark.createDataFrame([(*r, 1, 2, 0.5, 3, "h", "r", "k", 5, 6, 7, 8, 9) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
