import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

PASSAGE = " ".join(f"word{i}" for i in range(60))
#: Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own.
ROWS = [
    (1, PASSAGE + " one two three", "toxicity"), (2, PASSAGE + " one two four", None), (3, None, "x"), (4, "", "x"), (5, " \t\n", "x"),
    (6, "Single", "x"), (7, "sinGLE", "x"), (8, "a b", "x"), (9, "lead " * 30 + PASSAGE + " tail", "x"), (10, PASSAGE + " one two three", "x"),
    (10, PASSAGE + " one two three", "x"), (11, " ".join(f"w{i % 97}" for i in range(30_000)), "x"),
    (12, "Mail a@b.c_d@e.f or 1.2.3.4.5.6.7.8, 4111 1111-1111 1111 and +1 (988) 555-2485. 😀 é it's <|endoftext|>", "x"),
    (13, "x" * 5000 + " " + "9 " * 3000 + "a.b." * 2000, "x"), (None, "no id here at all", "x"), (14, "password=45bb0d53635bf1b89d. You idiot! Fine.", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return (spark.createDataFrame(ROWS, "doc_id long, text string, toxicity string").selectExpr(
        "*", "toxicity AS contamination", "'c' AS quality_score", "'p' AS pii", "1 AS n_words", "'k' AS kept", "'l' AS lang", "length(text) AS n_chars")
        .repartition(3))


@pytest.fixture(scope="session")
def odd_rows():
    return sorted(((i, t) for i, t, _ in ROWS if i is not None), key=lambda r: r[0])


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def doc_rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
