import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, fp string, score double"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwyzé") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts of all lengths, exact and near copies, nulls in every column, blanks, repeated rows and clashing columns."""
    rng = random.Random(5)
    out, k = [], 0

    def add(text, lang="en", source="a"):
        nonlocal k
        out.append((k, text, lang, source, None, 7, "x", "y", 0.5))
        k += 1

    for i in range(60):
        add(sentence(rng, rng.randint(3, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None]))
    base = sentence(rng, 120)
    for i in range(12):
        add(base if i % 3 else base.replace(" ", " \t\n", 3), "fr", "b")
    near = base.split()
    for i in range(8):
        near[i * 10] = "zz" + str(i)
        add(" ".join(near), "fr", "b")
    for text in (None, None, "", "   ", " \n\t", "one", "123 456", "¿? ---", "x" * 3000, "word " * 40, "A b C d"):
        add(text)
    add(sentence(rng, 6000), None, None)
    out.append(out[3])  # a row repeated whole
    out.append((None, "no id", None, None, None, None, None, None, None))
    out.append((None, base, "fr", "b", None, None, None, None, None))
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
