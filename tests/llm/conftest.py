import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n int, place int, part int"


def words(rng, count, names=400):
    return " ".join(f"w{rng.randrange(names)}" for _ in range(count))


def awkward():
    """Documents with nulls, empty and long texts, ties, copies, repeated rows and shared lines."""
    rng = random.Random(5)
    shared = words(rng, 30)
    rows = []
    for i in range(60):
        lines = [words(rng, rng.randrange(15, 60)) for _ in range(3)]
        if i % 3 == 0:
            lines.insert(1, shared)
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 1))
    near = rows[7][1].split(" ")
    for i in range(60, 72):
        copy = list(near)
        if i % 2:
            copy[10 + i % 20] = f"edit{i}"
        rows.append((i, " ".join(copy), "en", "s0", 1))
    rows += [
        (80, None, None, None, None),
        (81, "", "en", "s1", 0),
        (82, " \n\t\x0b ", "en", "s1", 5),
        (83, "one two", "en", None, 7),
        (84, "ONE two", "en", None, 7),
        (85, words(rng, 40_000), "en", "s2", 1),
        (85, words(rng, 50), "en", "s2", 1),
        (86, "a b  c\x85d é", "fr", "S\U0001f600", 1),
        rows[3],
        rows[3],
        (None, words(rng, 60), "en", "s1", 1),
    ]
    return [(*r, "k", 1, 2, 3) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
