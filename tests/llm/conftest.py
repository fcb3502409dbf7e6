import random

import pytest

SF = "/root/testdata/sf0.001"
#: Column names that the operators use themselves.
CLASH = "score double, fp long, digest string, key string, n long, block long, class string, line string, kept boolean"


@pytest.fixture(scope="session")
def tiny():
    """(id, text, source) rows: nulls, empty and blank texts, ties, repeated rows, copies, near copies, a long text."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
    base = " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(120))
    near = base.replace("alpha", "alpho", 1)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, base, "a"), (5, base.replace(" ", "\n\t", 3), "b"),
            (6, near, "b"), (6, near, "b"), (7, "one two", "c"), (8, "one two", "c"), (None, base, "a"), (None, None, None),
            (9, "idiot " * 3, "b"), (10, "x" * 5000, "a"), (11, " ".join(words[i % 12] + str(i) for i in range(9000)), "a"),
            (12, "über straße 🙂 naïve café " * 8, "c"), (7, "other text for the id seven", "c"), (13, "<|endoftext|> a  b \n c ", "a")]
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), "hot") for i in range(60)]
    return rows


@pytest.fixture()
def docs(spark, tiny):
    """The rows as a table with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, s, 0.5, 1, "d", "k", 2, 3, "c", "l", True) for i, t, s in tiny],
                                 f"doc_id long, text string, source string, {CLASH}")


@pytest.fixture()
def no_docs(docs):
    return docs.limit(0)
