import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, `a b` int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and blank texts, repeated rows, a long text,
    other scripts, and columns whose names clash with the operators' own."""
    rnd = random.Random(5)
    words = "the of and house river stone light garden letter window".split()

    def text(n):
        return "\n".join(" ".join(rnd.choice(words) for _ in range(12)).capitalize() + "." for _ in range(n))
    long = text(400)
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, text(3)), (4, text(3)), (5, "one two"), (6, "One  two"), (7, long), (8, long),
            (9, long + " more words here."), (10, "日本語 テキスト 🎉 ﬁ"), (11, "a" * 3000), (12, "é" * 50 + " \u00a0x"), (5, "one two"),
            (13, "mail bob.k@mail1.example.com or +1 (569) 555-6633 4539578763621486 at 10.1.2.3, password=ab12cd34ef56.")]
    out = [(i, t, "en" if k % 3 else None, "s1" if k % 2 else None, None, k, "x", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(out, DOC).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
