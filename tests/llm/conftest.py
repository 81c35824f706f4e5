import random

import pytest

WORDS = [a + b + c for a in ("ba", "co", "di", "fu", "ge", "lo") for b in ("ra", "ne", "ti", "mo") for c in ("", "s", "nt", "l")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): copies, near copies, shared passages, periodic, short, empty and null texts, and a repeated text under other keys."""
    r = random.Random(5)
    base = prose(1, 200)
    out = [(i, prose(100 + i, 30 + 3 * i)) for i in range(12)]
    for i in range(12, 24):
        w = base.split(" ")
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append((i, " ".join(w)))
    passage = prose(7, 60)
    out += [(i, f"{prose(200 + i, 20)}\n{passage}\n{prose(300 + i, 15)}") for i in range(24, 32)]
    out += [(32, base), (33, base), (34, "ab" * 300), (35, "a" * 250), (36, "x"), (37, ""), (38, None), (39, "  \n\t "), (40, "é" * 130 + prose(9, 40)), (41, "é" * 130), (42, "one two"), (43, "one two"), (44, "ONE  two")]
    r.shuffle(out)
    return out


@pytest.fixture
def docs(spark, rows):
    """The rows with columns whose names clash with the operators' own."""
    table = [(d, t, "en", f"h{d % 3}" if d % 5 else None, -1, "x", 0, "y") for d, t in rows]
    return spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n_words int, spans string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
