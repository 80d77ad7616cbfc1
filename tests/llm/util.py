"""Small tables for the training-data operators, with the cases every one must bear."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edited(text: str, seed: int, share: float) -> str:
    r = random.Random(seed)
    return " ".join(f"x{r.randrange(10**6)}" if r.random() < share else w for w in text.split(" "))


def rows():
    """Nulls in every column, empty, blank, short and very long texts, copies, near
    copies of several distances, a repeated row and a repeated key."""
    base, long = prose(1, 300), prose(2, 30_000, 5000)
    out = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "one", "en", "b", 3),
        (5, "one two", "en", "b", 7), (6, "ONE two", "en", "b", 7), (7, long, "de", "a", len(long)),
        (8, long + " tail", "de", "a", None), (9, base, "en", "a", len(base)), (10, base, "en", "c", len(base)),
        (10, base, "en", "c", len(base)), (11, "é ☃ 漢字  x", "fr", "c", 9), (None, base, "en", "a", 1),
        (None, None, None, None, None), (12, prose(3, 60) + "\n" + prose(3, 60) + "\nlast line of it", "en", "c", 1),
        (12, prose(4, 80), "en", "c", 1), (-5, "a b c d e f g h", "en", "b", 1),
    ]
    for i in range(40):
        out.append((100 + i, edited(base, i, (i % 8) / 60), "en", "a" if i % 3 else "b", 1))
    for i in range(20):
        out.append((200 + i, prose(100 + i, 30 + 20 * i), "en", "a", 1))
    return out


def documents(spark, extra: bool = False):
    """The rows above; with ``extra``, columns whose names clash with outputs and helpers."""
    df = spark.createDataFrame(rows(), DOC)
    if not extra:
        return df
    from pyspark.sql import functions as F
    names = ["shard", "Slot", "n_words", "kept", "score", "component_id", "n_tokens", "block", "deadline", "position",
             "label", "first", "node", "token", "at", "line", "id", "removed", "n_removed", "m", "a.b"]
    return df.select("*", *[F.lit("own").alias(n) for n in names])


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, found=None):
    found = found or [(9, 1, 0), (10, 1, 0), (10, 1, 0), (100, 0, 1), (100, 1, 0), (None, 1, 1), (101, None, None),
                      (999, 1, 1), (200, 0, 1), (201, 1, 0)]
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")
