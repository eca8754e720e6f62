"""Small fixtures shared by the tests of the training-data operators."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)))[:4] for r in rows]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], schema)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    names = ["".join(rng2.choice("abcdefghijklmnopqrst") for _ in range(rng2.randint(2, 8)))
             for rng2 in [random.Random(17)] for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))
