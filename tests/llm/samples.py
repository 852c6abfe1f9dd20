"""Small documents that hold the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _key string"


def documents(spark, n=120, seed=3, words=None):
    r = random.Random(seed)
    words = words or [f"{a}{b}" for a in "ba ko mi tu né Zö".split() for b in "ra lo ni te sü xi".split()]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(words) + r.choice(["", "", ".", ",\n", "  "]) for _ in range(r.randint(1, 400)))
        rows.append((i, text, r.choice(["xx", "yy"]), r.choice(["a", "b", "b", "b", None]), len(text), "clash", "clash"))
    rows.append((n, None, None, None, None, None, None))
    rows.append((n + 1, "", "xx", "a", 0, None, None))
    rows.append((n + 2, " ".join(r.choice(words) for _ in range(20_000)), "xx", "c", 0, None, None))
    rows.append((n + 3, rows[4][1], "xx", "a", 0, None, None))
    rows += [rows[5], rows[5]]
    rows.append((None, "kora kora", "xx", "a", 0, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
