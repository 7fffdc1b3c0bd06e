import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string, size int, spans string, copy string, name string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and blank texts, repeated rows, a very long text, ties, and columns with clashing names."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = body(90)
    rows = [(i, body(rng.randrange(1, 120)), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", None])) for i in range(40)]
    rows += [(50 + i, body(10) + "\n" + shared + "\n" + body(i), "en", "s1") for i in range(12)]
    copy = body(150)
    rows += [(70 + i, copy, "en", "s2") for i in range(6)]
    near = copy.split()
    rows += [(80 + i, " ".join(near[:i] + ["zzz"] + near[i + 1 :]), "fr", "s2") for i in range(1, 5)]
    rows += [(90, None, None, None), (91, "", "en", "s1"), (92, " \n\t ", "en", "s1"), (93, "one two", "en", "s1"), (94, "One TWO", "de", "s3")]
    rows += [(95, "a" * 700, "en", "s1"), (96, "x " * 40_000, "en", "s3"), (None, body(30), "en", "s1"), (5, rows[5][1], rows[5][2], rows[5][3])]
    full = [(i, t, lang, s, None if t is None else len(t), "k", 1, "s", "c", "n") for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
