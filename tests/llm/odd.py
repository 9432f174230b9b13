"""Documents with every oddity: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

from pyspark.sql import functions as F

EXTRA = ["score", "kept", "size", "key", "part", "row", "rank", "cluster", "component_id", "start", "block", "before", "licence", "target"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)


def texts() -> list[tuple]:
    """``doc_id, text, source``."""
    r = random.Random(5)
    words = lambda n: [r.choice("abcdefghij") * r.randint(1, 3) + r.choice(["", "ä", "-x", ".", "’s", "9"]) for _ in range(n)]
    base, other, passage = words(150), words(120), words(60)
    near = base.copy()
    near[70] = "changed"
    far = base.copy()
    far[10:140:9] = words(15)
    rows = [(1, " ".join(base), "a"), (2, " ".join(near), "a"), (3, " ".join(far), "b"), (4, "  " + "\n\t".join(base).upper() + " ", "b"),
            (5, " ".join(words(40) + passage + words(30)), "b"), (6, " ".join(words(10) + passage + words(3)), None),
            (7, "　".join(["one", "two"]) + " " + " ".join(passage), "c"), (8, None, "c"), (9, "", None), (10, " \n\t ", "a"), (11, "word", "é"),
            (12, "two words", "é"), (13, "three little words", "z"), (14, " ".join(words(30_000)), "z"), (15, "x" * 70_000, "a"), (16, " ".join(other), "a"),
            (17, "Some words.\nReleased under the MIT License.\nMore", "a"), (18, "\n\n  double  spaces\n\nand 'tis it's\r\nλόγος 日本 😀", "c"), (None, " ".join(other), "a"),
            (None, None, None)]
    return rows + rows[:3] + [(19, " ".join(base), "q")] * 2 + [(16, "another text with an id that stands twice", "a")]


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", s, None if t is None else len(t), *EXTRA) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3, F.col("text"))


def tuples(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=repr)
