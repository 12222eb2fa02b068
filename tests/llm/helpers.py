"""Small tables with awkward rows, and random texts with shared parts."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns whose names the operators use themselves.
CLASHING = "doc_id bigint, text string, w string, pos int, key string, n string, tok string, label string, score string, row string"


def awkward() -> list[tuple]:
    long_word = "x" * 70_000
    texts = [None, "", " ", "\n\t", "one", "a b c", "é😀 ß", long_word, ("word " * 3000) + "end", "same text here again and again", "same text here again and again"]
    return [(k, t, None, "s", None) for k, t in enumerate(texts)] + [(9, "same text here again and again", None, "s", None)]


def random_texts(n: int, seed: int, words: int = 40, vocabulary: int = 30) -> list[str]:
    r = random.Random(seed)
    vocabulary_words = [f"w{k}" for k in range(vocabulary)]
    return [" ".join(r.choice(vocabulary_words) for _ in range(r.randint(0, words))) for _ in range(n)]


def documents(spark, texts: list, first: int = 0):
    return spark.createDataFrame([(first + k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], SCHEMA)
