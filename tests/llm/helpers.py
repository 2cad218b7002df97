"""What the tests of the training-data operators share."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


def words(r: random.Random, n: int, alphabet="abcdefgh", longest=6) -> str:
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, longest))) for _ in range(n))


#: Names that operators use inside; extra columns may have them as well.
CLASHES = ("id", "n", "key", "th", "fp", "size", "start", "copies", "rank", "kept", "h", "r", "row", "score", "bucket", "n_lines", "target", "taken", "failed", "c0")


def with_clashes(df):
    from pyspark.sql import functions as F

    for c in CLASHES:
        df = df.withColumn(c, F.lit("x"))
    return df


#: Names that stages use inside, or that need quoting.
ODD = ("a.b", "__id", "__x", "__pos", "row", "col0_", "pos", "blank_", "kept", "A`b")


def with_odd(df):
    """``df`` with a column of each odd name that holds the id as text."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.col("doc_id").cast("string").alias(c) for c in ODD])
