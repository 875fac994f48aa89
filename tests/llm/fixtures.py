"""Small tables for the operators: every awkward case once."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and on at shore river plan maps winter under stone bridge early light people work house north small".split()


def prose(seed: int, n: int = 60) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n)) + "."


AWKWARD: list[tuple[int | None, str | None]] = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "a"), (None, "an id that is null, with some words"), (5, prose(5)), (5, prose(5)), (6, prose(5)),
    (7, "x" * 3000), (8, prose(8, 4000)), (9, "Élan vital, naïve café — 你好世界 🙂🙂  end"), (10, "don't we'll 's  they're 12345 !!! \n\n\n  ok "), (-3, "!!! ??? ..."), (11, "same same same same same same same same"),
]


def rows(pairs=AWKWARD):
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]


def table(spark, pairs=AWKWARD):
    return spark.createDataFrame(rows(pairs), SCHEMA)


def clashing(spark, pairs=AWKWARD):
    """The same with columns named like an operator's own."""
    names = ("node", "bucket", "gram", "home", "cell", "label", "hash", "language", "accepted", "score", "start", "tokens", "n_tokens", "salt", "tier", "window_id")
    from pyspark.sql import functions as F

    return table(spark, pairs).select("*", *(F.lit("x").alias(n) for n in names))
