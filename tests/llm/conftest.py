from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus() -> list[tuple]:
    """Documents with copies, near copies, boilerplate, odd texts, nulls, a hot source and a long one."""
    rng = random.Random(5)
    rows = []
    for i in range(240):
        words = prose(rng, rng.randrange(8, 160))
        if i % 12 == 5 and rows:  # exact copy
            text = rows[-3][1]
        elif i % 12 == 7 and rows:  # near copy
            words = (rows[-2][1] or "").split(" ")
            if len(words) > 3:
                words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = " ".join(words[: len(words) // 2]) + "\n" + " ".join(words[len(words) // 2 :])
        if i % 3 == 0:
            text = "Home About Contact\n" + text
        rows.append((i, text, ("en", "de", None)[i % 3], "hot" if i % 3 else f"s{i % 7}", len(text)))
    odd = ["", None, "   \n\t ", "one", "a b c d", "É ÜBER ß\x0b日本 語", "word " * 40, "!!! ???", "x" * 3000, "\n\n\n"]
    rows += [(300 + k, t, None, None if k % 2 else "", None) for k, t in enumerate(odd)]
    rows.append((320, " ".join(prose(rng, 20_000)), "en", "hot", None))  # a very long text
    rows += [(321, "same row again and again", "en", "hot", 24)] * 3  # repeated rows
    rows.append((321, "the same id with another text", "en", "hot", 24))
    rows.append((None, "a text without an id", "en", None, 20))
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names operators use in results."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("score", "size", "copies", "fingerprint", "next", "row", "content", "component_id", "dropped_lines", "label"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
