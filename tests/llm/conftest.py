from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ba", "de", "ki", "lo", "mu", "ta", "re", "so") for b in ("n", "r", "st", "l", "m") for c in ("a", "e", "ing", "o", "us")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def document(r: random.Random, lines: int = 6) -> str:
    return "\n".join(sentence(r, r.randint(6, 18)) for _ in range(lines))


def edited(r: random.Random, text: str, n: int) -> str:
    words = text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = r.choice(WORDS)
    return " ".join(words)


def corpus(seed: int = 1) -> list[tuple]:
    """Documents with copies, near copies, shared lines and passages, odd texts and repeated rows."""
    r = random.Random(seed)
    texts: list[str | None] = [document(r) for _ in range(25)]
    base, passage = texts[3], document(r, 4)
    texts += [base] * 6 + [edited(r, base, r.randint(1, 4)) for _ in range(25)] + [edited(r, texts[5], r.randint(1, 12)) for _ in range(12)]
    texts += [document(r, 2) + "\n" + passage + "\n" + document(r, 2) for _ in range(8)]
    texts += [None, "", " \n ", "one", "two words", "two words", "A b c d", "a b c d", "x" * 450, "x" * 450 + "y", "é日本語 " * 60, "é日本語 " * 60 + "z"]
    texts += [document(r, 3) + "\nReleased under the MIT License.\n" + document(r, 1), "Licensed under CC BY-NC 4.0.\n" + document(r, 2)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, rows):
    """The corpus with a repeated row, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([*rows, rows[0]], SCHEMA).repartition(3, "doc_id")
    return frame.withColumns({c: F.lit("mine") for c in ("key", "id", "mark", "lines", "of", "label", "score", "n_words")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def unnamed(spark):
    """Rows without doc_id, null and empty texts."""
    return spark.createDataFrame([(None, "some words here and there now", "en", "s", 1), (None, None, None, None, None), (None, "", "en", "s", 0), (4, None, "en", "s", 0)], SCHEMA)
