"""Documents with every odd case: nulls, empty and very long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, h string, fp string, lo string, doc string"
LONG = " ".join(f"word{i % 997}x{i % 31}" for i in range(30_000))


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(300)
    near = base.split()
    near[150] = "changed"
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "one two three"), (6, base), (7, base), (8, " ".join(near)), (9, base + "\n"),
        (10, prose(40) + " " + passage + " " + prose(30)), (11, passage + "\n" + prose(50)), (12, prose(20) + " " + passage), (13, LONG), (14, "Ünïcödé — «ça» 漢字 " * 40),
        (15, "a\n" * 30 + "x" * 45 + "\n" + "X" * 45 + "\n"), (16, "y" * 300), (None, base), (None, None), (6, base), (20, prose(500)),
        *((30 + i, f"{prose(15)}\nThis very line is repeated in many documents of the corpus.\n  THIS very line is repeated in MANY documents of the corpus.\t\n{prose(3)}") for i in range(7)),
    ]
    return [(i, t, "en", "src", len(t or ""), "k", "s", "h", "f", "l", "d") for i, t in texts]


def frame(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, COLUMNS)
