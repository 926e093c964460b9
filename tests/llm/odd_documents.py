"""Documents of every kind that the operators must bear."""

from __future__ import annotations

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Columns whose names the operators use themselves.
CLASHING = ["row_key", "id", "key", "drop", "n_lines", "n_words", "component_id", "score", "_id", "doc", "new", "cls", "k", "i"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(("alpha", "beta", "gamma", "Delta", "été", "straße", "x1", "日本")) + str(rng.randrange(400)) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Null, empty, blank, very short and very long texts, copies, near copies, shared lines and passages."""
    rng = random.Random(3)
    shared = "Shared LINE of a good number of documents, " + "z" * 20
    base, long = prose(rng, 120), prose(rng, 30_000)
    near = base.split(" ")
    near[60] = "changed"
    out: list[str | None] = [None, "", " \t\n ", "\n\n", "one", "one two three", "!!! ...", "é" * 50_000, "a" * 3000, "\x00nul\x00" * 60,
                             base, base, base.upper(), " ".join(near), long, long + " tail", "The end.\nThe end."]
    for k in range(8):
        out.append(f"{prose(rng, 20)}\n{' ' * (k % 3)}{shared.upper() if k % 2 else shared}\t\r\n{prose(rng, 15)}")
    for _ in range(3):
        out.append(f"{prose(rng, 10)} {base[100:420]} {prose(rng, 10)}")
    out += [prose(rng, 40) for _ in range(20)]
    return out
