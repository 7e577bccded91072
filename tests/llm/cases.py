"""Small tables with every awkward case, shared by the tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bands string, __score string, key string"

WORDS = [a + b for a in ("ka", "lo", "mi", "ter", "sun") for b in ("n", "rel", "ta", "vo", "x", "é")] + ["the", "of", "and", "to"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def texts() -> list[str | None]:
    a, b = prose(1, 200), prose(2, 120)
    edited = b.split()
    edited[60] = "changed"
    shared = prose(3, 70)
    out = [
        a, a, a, b, " ".join(edited), b + " tail", None, "", " \n\t ", "one", "One two", "ONE two", "the of and",
        shared + " " + prose(4, 90), prose(5, 40) + "\n" + shared, prose(6, 30) + "  " + shared.replace(" ", "\n", 5) + " " + prose(7, 30),
        "word " * 400, "x" * 5000, prose(8, 6000), "é漢字 ▁  x y \x1c z", "a b c d e f", "a b c d e f g",
        "This file is under the MIT License, mit license. Apache-License too", "*** $$$ " * 60, "Tabs\tand\x0bother\x0cspaces\r\nhere " * 30,
    ]
    return out


def rows() -> list[tuple]:
    base = [(k * 3, t, "en", "src0", len(t) if t is not None else None, "b", "s", "k") for k, t in enumerate(texts())]
    odd = [base[0], base[3], (None, "no id here " * 20, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (1 << 40, prose(1, 200), "en", "src1", 1, "b", "s", "k"), (-5, prose(9, 80), "en", "src1", 1, "b", "s", "k"), (-5, prose(10, 80), "en", "src1", 1, "b", "s", "k")]
    return base + odd


def frame(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def seen(df, *columns) -> list:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
