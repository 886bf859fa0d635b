"""Small made documents, and plain restatements of what operators promise."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def rows(texts):
    """(doc_id, text, lang, source, n_chars) for texts by id."""
    return [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def rng(seed=1):
    return random.Random(seed)
