from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
WORDS = ["".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=3 + k % 6)) for k in range(900)]


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    lines = [" ".join(pick.choice(WORDS) for _ in range(20)) for _ in range(n // 20 + 1)]
    return "\n".join(lines)


def edited(text: str, seed: int, every: int) -> str:
    """The text with one word in so many replaced."""
    pick = random.Random(seed)
    return " ".join("changed" if pick.random() < 1 / every else w for w in text.split(" "))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a/test"), (1, base, "en", "a/test"), (2, None, None, None), (3, "", "en", "b"), (None, prose(2, 80), "en", "b"),
        (None, None, "en", "b"), (5, prose(3, 30_000), "en", "b"), (6, "one two", "en", "b"), (7, "one two", "en", "b"), (8, " \n\t \x0b\x0c\r", "en", "b"),
        (9, "é▁ß 日本語  x y \x1c z <|endoftext|> 'tis▁", "fr", "c"), (10, "word " * 4000, "en", "c"), (11, "x" * 30_000, "en", "c"), (12, base + " end", "en", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    clash = {c: F.lit(c) for c in ("row", "node", "hub", "key", "path", "ids", "seed", "part", "label", "features", "item_id", "record", "words", "line", "score", "kept", "page_id")}
    return df.withColumn("n_chars", F.length("text").cast("bigint")).withColumns(clash)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
