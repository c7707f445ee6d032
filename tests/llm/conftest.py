import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "an", "of", "tion", "er", "ing", "wh", "ble", "hé", "or", "ea", "st"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(words)]
    return "".join(w + (".\n" if i % 13 == 12 else " ") for i, w in enumerate(made))


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, ties, copies and near copies, repeated rows."""
    base = prose(1, 300)
    near = base.split(" ")
    near[150] = "changed"
    shared = prose(2, 60)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t\x0b ", "en", "b", 5), (None, prose(3, 80), None, None, None),
        (None, None, None, None, None), (4, base, "en", "a", 1), (5, base, "en", "b", 1), (6, " ".join(near), "en", "a", 1),
        (6, " ".join(near), "en", "a", 1), (7, prose(4, 30000), "en", "c", 1), (8, "one two", "en", "c", 7), (9, "one two", "de", None, 7),
        (10, "x" * 3000, "en", "a", 3000), (11, "ab " * 400, "en", "a", 1200), (12, prose(5, 200) + shared, "en", "a", 1),
        (13, prose(6, 150) + shared + prose(7, 90), "en", "b", 1), (14, "<|endoftext|>Ünïcödé 中文 \U0001f600 it's 12'345  \r\n", "en", "b", 1),
        (15, "mail a.b@c.example.org or +1 (415) 555-0199, 10.0.0.255, 4111 1111 1111 1111; token = \"abc123def456abc123def456\"", "en", "b", 1),
        (16, prose(8, 120).replace(" ", "## ", 60), "en", "a", 1), (17, "same line here\n" * 90, "en", "a", 1),
    ]
    return rows + [(20 + i, f"Shared boilerplate line of this host.\n{prose(100 + i, 70)}", "en", "hub", 1) for i in range(14)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark):
    """The columns that operators make, already there under the same or other letters."""
    names = ["text_in", "_text_in", "ids", "IDS_in", "n_words", "statistics", "spans", "row", "key", "hash", "block", "body", "bands",
             "hi", "node", "h", "source_size", "kept", "mix_size_", "N"]
    return spark.createDataFrame([(r[0], r[1], r[3], *range(len(names))) for r in odd_rows()],
                                 "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
