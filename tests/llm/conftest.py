import random

import pytest

#: Names that the operators use inside.
CLASHES = ["key", "node", "n", "_row", "h", "words", "kept", "place", "block", "spans", "start", "id_a", "_verdict", "copies", "line", "comp", "page", "_range", "conv"]


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """A session of tests has a shared folder of its own where the cluster names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture(scope="session")
def prose():
    def make(seed, n_words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 9))) for _ in range(n_words))

    return make


@pytest.fixture(scope="session")
def table(spark):
    """A documents table with extra columns that clash; rows are (doc_id, text, lang, source)."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), *CLASHES) for i, t, lang, s in rows], schema)

    return make


@pytest.fixture(scope="session")
def hard_rows(prose):
    """Nulls, empty and long texts, ties, repeats."""
    long = prose(1, 30_000)
    a = prose(2, 60)
    return [
        (1, a, "en", "x"), (1, a, "en", "x"), (2, a, "en", "y"), (3, None, "en", "x"), (4, "", None, "x"), (5, " \n\t ", "de", None), (None, a, "de", "x"),
        (None, None, None, None), (6, long, "fr", "x"), (7, long + " tail", "fr", "y"), (1, "another text under one id", "en", "x"), (8, "é " * 5, "fr", "x"),
    ]
