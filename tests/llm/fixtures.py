"""Small tables with every awkward case: NULLs, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "der", "ou", "ti", "es", "on", "lé", "ß", "Ch", "the"]
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(n))


def texts() -> list[str | None]:
    base = prose(1, 160).split()
    copies = [" ".join(base)] * 3
    for i in range(6):
        near = list(base)
        near[20 * i + 5] = f"changed{i}"
        copies.append(" ".join(near))
    shared = prose(2, 60)
    passages = [f"{prose(10 + i, 30)} {shared} {prose(20 + i, 30)}" for i in range(3)]
    runs = ["run " * 70, "run " * 90 + prose(3, 60), "a b " * 60, prose(4, 10) + " a b" * 50]
    odd = [None, "", " \t\n", "one", "One TWO", "one two", "x" * 3000, prose(5, 4000), "▁ \u2028 é😀",
           "Released under the MIT License.", "GNU General Public License, mit license"]
    return copies + passages + runs + odd + [prose(40 + i, 80) for i in range(8)]


def rows() -> list[tuple]:
    return [(i, t, "en", ["b", None, "a", ""][i % 4], len(t or "")) for i, t in enumerate(texts())]


def documents(spark, extra: bool = False):
    """The documents in several partitions, if wanted with columns whose names clash."""
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    return df.selectExpr("*", "1 AS taken", "'x' AS score", "2 AS spans", "3 AS ids", "4 AS part",
                         "5 AS n", "6 AS labels") if extra else df


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
