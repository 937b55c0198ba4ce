"""Awkward rows and plain-Python models shared by the tests."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-/:-@\[-\^`{-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASHING = "node tkey value n vals comp a b begin shard slot pos rank s text_ id_ key_ score".split()

LONG = " ".join(f"word{i % 977} thing{i % 31} the und" for i in range(60_000))
A = "the river runs quietly past the old mill while the farmer counts his sheep in the evening light"
B = A.replace("evening", "morning")


def words(text):
    return WORD.findall((text or "").lower())


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


ODD = [
    (1, A, "en", "web"), (2, A, "en", "web"), (3, B, "en", "books"), (4, None, None, None), (5, "", "en", "web"),
    (6, " \t\n .,!? ", "de", "web"), (7, LONG, "en", "web"), (7, LONG, "en", "web"), (8, A, None, None),
    (None, A, "en", "web"), (None, None, None, None), (9, "hello", "fr", "books"), (9, "different text under one id", "fr", "books"),
]


def odd(spark):
    df = docs(spark, ODD)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def empty(spark):
    return docs(spark, ODD).limit(0)


def components(nodes, edges):
    """Least member of each node's connected component."""
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0
