from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that operators use for columns of their own.
CLASHES = ("row", "raw", "cls", "n", "id", "_t", "_id", "_text", "key", "r", "bucket", "score", "_hits", "_keep", "shard", "start")


def crowded(df: DataFrame) -> DataFrame:
    """The table with further columns that clash with operators' own, one of them all null."""
    for i, c in enumerate(CLASHES):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string") if i == 0 else F.lit(i))
    return df


def words(r: random.Random, n: int, size: int = 40) -> str:
    return " ".join(r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(size)) for _ in range(n))


@pytest.fixture(scope="session")
def texts() -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, empty, null, very long, repeated rows, odd characters."""
    r = random.Random(1)
    base = [words(r, n) for n in (3, 8, 60, 120, 300, 700)]
    out: list[tuple[int | None, str | None]] = []
    for k, b in enumerate(base):
        w = b.split()
        for m in range(4):
            x = list(w)
            for _ in range(m * max(1, len(w) // 120)):
                x[r.randrange(len(x))] = "zz" + str(r.randrange(5))
            out.append((k * 10 + m, " ".join(x)))
    passage = words(r, 90)
    out += [(100 + i, words(r, 20 + i) + "\n" + passage + "\n" + words(r, 30)) for i in range(6)]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "ONE"), (205, "é" * 500), (206, "x" * 5000), (207, "ab" * 4000 + " tail")]
    out += [(208, "a\xa0b  c\x1c d\x85e 日本語 don't WE'VE <|endoftext|> x<|startoftext|>"), (209, words(r, 6000))]
    out += [(0, out[0][1]), (0, out[0][1]), (None, base[3]), (None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts) -> DataFrame:
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    return crowded(df.repartition(5))


@pytest.fixture(scope="session")
def nothing(spark) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
