"""Invented documents for the tests of the corpus operators."""

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    # names that operators use inside or add
    "block int, shard int, slot int, size int, n_words int, n_removed int, kept string, `range` int, halo int, "
    "weight double, probability double, topic string, id int, label int, length int, start int, expected_grade string"
)
EXTRA = (1, 2, 3, 4, 5, 6, "x", 7, 8, 0.5, 0.25, "t", 9, 10, 11, 12, "g")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(n))


def make(spark, texts, first=0):
    """Documents with clashing extra columns; texts are strings, or pairs of id and string."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (first + i, t)
        size = None if text is None else len(text)
        rows.append((key, text, None if i % 7 == 3 else "en", None if i % 5 == 2 else f"src{i % 3}", size, *EXTRA))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
