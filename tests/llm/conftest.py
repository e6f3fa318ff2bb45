import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, score double, label int, shard string, n_chars long"


def _word(rng):
    return "".join(rng.choice(["an", "th", "er", "ou", "ti", "ü", "É"]) for _ in range(rng.randint(1, 4)))


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls in every column, empty and long texts, copies, near copies, repeated rows, and
    columns whose names operators use themselves."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        n = rng.choice([1, 3, 6, 40, 80, 200])
        text = " ".join(_word(rng) for _ in range(n))
        rows.append([i, text, "en", f"s{rng.choice([0, 0, 0, 1, 2])}", 0.5, 1, "x", n])
    rows += [[100 + i, rows[i][1], "de", None, None, None, None, None] for i in range(0, 20)]
    for i in range(20, 50):  # near copies, some beyond the radius
        w = rows[i][1].split(" ")
        for _ in range(rng.choice([1, 2, 4])):
            w[rng.randrange(len(w))] = _word(rng)
        rows.append([200 + i, " ".join(w), "en", "s3", 0.1, 0, "y", 1])
    rows += [
        [300, None, None, None, None, None, None, None], [301, "", "en", "s1", 0.0, 0, "", 0], [302, " \n\t ", "en", "s1", 0.0, 0, "", 0], [303, "", "en", "s1", 0.0, 0, "", 0],
        [None, "null id text here we go again and again", "en", "s1", 0.0, 0, "", 0], [None, rows[7][1], "en", "s1", 0.0, 0, "", 0],
        [304, "Same Row", "en", "s1", 0.0, 0, "", 0], [304, "Same Row", "en", "s1", 0.0, 0, "", 0], [305, "A B\x1fC D E f g", "en", "s1", 0.0, 0, "", 0],
        [306, "long " + " ".join(_word(rng) for _ in range(30_000)), "en", "s2", 0.0, 0, "", 0], [307, "line one\nline one\n\nline one\nx", "en", "s2", 0.0, 0, "", 0],
    ]
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    """Labels for statistics-rich junk and insults of the learned tests; null and repeated ones among them."""
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (1, None, None), (1, 1, 0), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
