"""Small tables with the awkward rows every corpus operator has to take."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["size", "target", "copies", "taken", "key", "cls", "n", "bands", "label", "spans", "runs", "piece", "shard", "score"]

SF = "/root/testdata/sf0.001"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def rows() -> list[tuple]:
    long = words(1, 6000)
    twin = words(2, 120)
    near = " ".join([*twin.split()[:-2], "other", "end"])
    out = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "One two", None, None, 7), (4, long, "en", "a", len(long)),
        (5, twin, "de", "b", len(twin)), (6, twin, "de", "b", len(twin)), (6, twin, "de", "b", len(twin)),
        (7, near, None, "a", 0), (None, twin, "fr", None, 1), (None, None, None, None, None), (9, " \t\n ", "en", "a", 4),
        (10, "é" * 150 + " " + "ß" * 150, "de", "c", 301), (11, "x\x00y " * 60, "en", "c", 240), (12, twin + "\n" + words(3, 40), "en", "a", 9),
        (12, words(4, 30), "en", "a", 9),
    ]
    return out


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def with_clashes(frame):
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, data):
    return spark.createDataFrame(data, "doc_id long, quality int, toxic int")
