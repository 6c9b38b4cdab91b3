"""Small tables with what operators must bear: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join("".join(chr(97 + int(d)) for d in str(rng.randint(0, words))) + "es" for _ in range(n))


def documents(spark, seed=0, extra=()):
    rng = random.Random(seed)
    a, b = prose(rng, 80), prose(rng, 40)
    rows = [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, a + " end", "en", "s2", 1), (4, None, None, None, None), (5, "", "en", "s1", 0),
        (6, " \n\t ", "en", "s2", 0), (7, "one two", "en", "s2", 7), (8, b, "de", "s1", 1), (9, prose(rng, 30) + " " + b + " " + prose(rng, 30), "de", "s2", 1),
        (10, prose(rng, 3000), "fr", "s3", 1), (None, b, "de", "s1", 1), (11, "1234 5678", "en", "s1", 1), (11, "1234 5678", "en", "s1", 1),
        (12, "ÄÖ " * 60, "de", "s1", 1), (13, "x" * 5000, "en", "s1", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in extra:
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(7))
    return df


CLASH = ("key", "size", "shard", "fp", "fingerprint", "component_id", "slot", "bucket", "part", "row", "score", "lang_pred", "_id", "kept", "n_words", "failed")
