"""Small tables with the awkward rows every operator must bear."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, k string, node string"
BLANK = ("x", "y", 1, "clash", 2, "clash", "clash")


def documents(spark, rows):
    """(doc_id, text) rows as documents, with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, *BLANK) for i, t in rows], SCHEMA)


def prose(seed: int, words: int) -> str:
    """Different words for every seed, with a few that all share."""
    return " ".join("the" if k % 7 == 3 else f"w{seed}x{k * 31 % 997}" for k in range(words))


AWKWARD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (None, prose(9, 120)),
    (5, prose(9, 120)),
    (6, prose(9, 120)),
    (6, prose(9, 120)),
    (7, "x" * 5000 + " " + prose(7, 6000)),
]
