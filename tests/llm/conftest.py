import random

import pytest

WORDS = "alpha beta gamma delta the of and to über straße año niño él 你好 x y zz end.\n run:".split(" ")


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, copies, near copies, long and odd texts."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(1, 120)) for _ in range(60)]
    near = [base[0] + " more", base[1].replace("alpha", "Alpha", 1), base[2] + " " + base[3]]
    odd = [None, "", " \n\t ", "a", "a b", "a b c", "A\x0bB\x0cC\x1cD\x85E F", "x" * 3000, "😀 " * 50, "\n".join(["same line here"] * 9), "  two  spaces \n\n and lines ", "it's we'll 12345 €%$#"]
    long = " ".join(base) * 6
    return base + base[:7] + near + odd + [long, None, ""]


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), "extra") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
