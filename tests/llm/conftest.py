import random

import duckdb
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made_up(seed: int = 3, n: int = 260) -> list[tuple]:
    """Documents with copies, near copies, junk, repeats, nulls, empty and long texts."""
    random.seed(seed)
    syllables = "the of and er in on th re ti es or te ed is it al ar st to nt".split()
    words = ["".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(400)]

    def prose(count: int) -> str:
        return "\n".join(
            " ".join(random.choices(words, k=random.randint(3, 12))) + "." for _ in range(max(1, count // 8))
        )

    rows = []
    for i in range(n):
        source = random.choice(["a", "b", "hot", "hot", "hot", None])
        lang = random.choice(["en", "en", "de", None])
        text = prose(random.choice([10, 40, 120, 200]))
        if i % 9 == 0 and rows:
            text = rows[-1][1]
        if i % 11 == 0 and rows:
            text = (rows[-1][1] or "") + " tail"
        if i % 13 == 0:
            text = "All rights reserved\n" + text
        if i % 17 == 0:
            text = "*** ".join(text.split())
        if i % 19 == 0:
            text = (text.split("\n")[0] + "\n") * 9
        rows.append((i, text, lang, source, len(text)))
    long_text = prose(20_000)
    rows += [
        (n, None, "en", "hot", None),
        (n + 1, "", None, None, 0),
        (n + 2, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (n + 3, long_text, "de", "b", len(long_text)),
        (n + 4, "x" * 60_000, "de", "b", 60_000),
        (n + 5, "École ÀÉ 漢字 ▁   ſecret \U0001f600", "fr", "é", 25),
        (None, "no id at all", "en", "a", 12),
        (None, None, None, None, None),
        (7, rows[7][1], rows[7][2], rows[7][3], rows[7][4]),
        (7, rows[7][1], rows[7][2], rows[7][3], rows[7][4]),
        (8, "another text under a used id", "en", "a", 28),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return made_up()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with columns whose names the operators use themselves."""
    names = (
        "row id size key shard slot host page line drop n_lines n_dropped words lines hashes windows placed starts "
        "print component mask bits n_words kept base_failed fence token_ids n_tokens round_trip copies target p draw "
        "hash count spans tokens base place part last n_known score"
    ).split()
    return docs.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])


@pytest.fixture(scope="session")
def duck(rows):
    """DuckDB with the made-up documents."""
    import pandas as pd

    connection = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    frame = frame.astype({"doc_id": "Int64", "n_chars": "Int64"})
    connection.execute(
        "CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)"
    )
    connection.executemany(
        "INSERT INTO documents VALUES (?, ?, ?, ?, ?)",
        [[None if pd.isna(v) else v for v in row] for row in frame.astype(object).itertuples(index=False)],
    )
    return connection
