"""Small documents with awkward rows, and plain-Python helpers the brute-force versions share."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, content long, "
          "component string, a string, b string, key string, doc string, bucket string, copy_of long, number string, rate_ string")


def rows(texts, ids=None, langs=None, sources=None):
    """Rows of SCHEMA: the contract's columns, then columns whose names operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    out = []
    for k, (i, t) in enumerate(zip(ids, texts)):
        lang = langs[k] if langs else "en"
        source = sources[k] if sources else "src0"
        out.append((i, t, lang, source, None if t is None else len(t), None, None, 7, "c", "a", "b", "k", "d", "u", None, None, "r"))
    return out


def frame(spark, texts, **more):
    return spark.createDataFrame(rows(texts, **more), SCHEMA)


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def edited(rng: random.Random, text: str, changes: int) -> str:
    words = text.split(" ")
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at] = f"e{rng.randrange(10_000)}"
    return " ".join(words)
