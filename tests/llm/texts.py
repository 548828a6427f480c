"""Rows and texts that the tests of this folder share."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
#: Extra columns whose names the operators use themselves.
CLASHING = ("score", "fp", "row", "spans", "pii_spans", "items", "size", "n_words", "batch", "held_out", "label", "bucket", "features", "component", "t", "id")


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASHING])


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("aeinrst") for _ in range(r.randint(2, 8))) for _ in range(n))
