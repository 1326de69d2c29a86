import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, start string, cut string, hits string, licence string"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(["an", "th", "er", "in", "on", "re", "le", "é", "ß"], k=rng.randint(1, 4))) + rng.choice(["", "", "", ".", ","]) for _ in range(words))


def edited(text: str, seed: int, changes: int) -> str:
    rng, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="session")
def rows():
    """Ordinary texts, copies, near copies, a shared passage, nulls, empty and long texts, repeated rows and ids."""
    base, passage = prose(1, 300), prose(2, 120)
    out = [(i, prose(100 + i, 60 + i)) for i in range(1, 12)]
    out += [(20, base), (21, base), (22, edited(base, 1, 3)), (23, edited(base, 2, 6)), (24, edited(base, 3, 90))]
    out += [(30, prose(30, 40) + "\n" + passage + "\n" + prose(31, 40)), (31, prose(32, 50) + " " + passage), (32, "aaaa " * 300)]
    out += [(40, None), (41, ""), (42, " \n\t"), (43, "one"), (44, "ONE two"), (45, "one  two "), (46, "line one\nline one\n\nLine one\n" * 3), (None, prose(50, 80)), (None, None), (47, base), (47, base), (48, prose(60, 8000))]
    out += [(50, "Licensed under the Apache License, Version 2.0.\n" + prose(61, 30)), (51, prose(62, 20) + " mit license cc by CC-BY gnu general public\nlicense"), (52, "GNU general"), (53, "#*$%&|<> " * 20), (54, "\x00 a\x00b  c <|endoftext|>")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With columns whose names clash with results and helpers."""
    data = [(i, t, ["en", "fr", None][k % 3], "s", len(t or ""), "x", "x", "x", "x", "x", "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
