"""Small tables with what real ones hold: nulls, empty and long texts, ties, repeats, clashing names."""

import random


def words(n, seed=0):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]


LONG = " ".join(words(30_000, 5))
PASSAGE = " ".join(words(70, 9))

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, None, "en", None),
    (3, "", None, "b"),
    (4, "   \n\t ", "fr", "b"),
    (5, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, LONG, "en", "b"),
    (7, "Alpha beta gamma delta epsilon zeta eta theta", "en", "c"),
    (None, "a text of no document id", "en", "c"),
    (None, "a text of no document id", None, None),
    (8, " ".join(words(60, 1)) + " " + PASSAGE + " " + " ".join(words(40, 2)), "de", "c"),
    (9, " ".join(words(45, 3)) + " " + PASSAGE + " " + " ".join(words(50, 4)), "de", "c"),
    (10, "Ünï ço∂é Ωmega straße İstanbul ΣΑΣ naïve 日本語 text 🙂 x", "fr", "c"),
    (11, "12345 67890 !!! ???", "fr", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows=ROWS):
    """With columns whose names the operators could want for themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("_key", "_elsewhere", "_keep", "_gone", "_language", "_url", "_matched", "_block", "_rule"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("fp", F.lit("x")).withColumn("digest", F.lit(7)).withColumn("w", F.lit(None).cast("int")).withColumn("n_chars", F.length("text").cast("long"))


def empty(spark):
    return docs(spark).limit(0)
