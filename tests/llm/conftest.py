import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, shard string, score string, line int, k long, m int, _gone string, _n string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(7)
    base = words(rng, 120)
    near = base.replace(base.split()[50], "zzz", 1)
    out = [
        (1, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (2, base, "en", "a", len(base)),
        (3, near, "en", "b", len(near)),
        (4, "", "en", None, 0),
        (5, None, None, None, None),
        (None, "a text without an id\nand a second line of five words", "de", "c", 10),
        (None, None, None, None, None),
        (6, " \t\n\x0b\x0c\r ", "fr", "b", 7),
        (7, words(rng, 30_000), "en", "a", 1),
        (8, "One Two THREE", "en", "c", 13),
        (9, "ÄÖÜ straße naïve 漢字 😀 text with spaces", "de", "c", 20),
    ]
    out += [(20 + i, words(rng, rng.randint(1, 60)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "d"]), 5) for i in range(60)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """rows with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2, "x", "y", 3, 4, 5, "g", "n") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
