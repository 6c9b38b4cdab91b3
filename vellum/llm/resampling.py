"""Target-distribution importance resampling over hashed word n-grams.

A table of positions holds a row per word of every document; ``lead()`` over a document's positions
joins the following words to it, so a row has the run of each order that starts there. Runs are hashed
into buckets, buckets are counted in the corpus and in the target texts, and the gain of a bucket is the
smoothed logarithm of how much likelier the target makes it. A document's weight is the mean gain of its
runs. Gumbel noise from the document's id turns the best scores into a draw without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import numbered, settle

#: What lies between words: ASCII but for digits and letters, once capitals have been lowered.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL)
    return F.array_remove(F.split(low, BREAK), "")


def positions(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """The position table of ``rows`` (id unique, text, any others): bucket_1 .. bucket_``order`` for each word.

    bucket_k is that of the run of k words starting there, null where the text ends before; a row
    without words has one row of nulls. Rows meet once, by their id, so a text's words and the window
    over them stay in its task.
    """
    kept = [c for c in rows.columns if c != "text"]
    told = rows.repartition("id").select(*kept, F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    own = Window.partitionBy("id").orderBy("pos")
    run, runs = F.col("word"), {}
    for k in range(1, order + 1):
        # concat is null as soon as one of the words is missing
        run = F.concat(run, F.lit(" "), F.lead("word", k - 1).over(own)) if k > 1 else run
        runs[f"run_{k}"] = run
    told = told.select(*kept, *[r.alias(n) for n, r in runs.items()])
    return told.select(*kept, *[(F.crc32(F.col(f"run_{k}").cast("binary")) % buckets).cast("int").alias(f"bucket_{k}") for k in range(1, order + 1)])


def counted(table: DataFrame, order: int, name: str) -> DataFrame:
    """(bucket, ``name``): how many runs of all orders lie in each bucket that has any."""
    each = F.explode(F.array(*[f"bucket_{k}" for k in range(1, order + 1)]))
    return table.select(each.alias("bucket")).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, from (bucket, s) and (bucket, t); counts are smoothed by one each."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = settle(every.join(corpus, "bucket", "left").join(target, "bucket", "left").na.fill(0, ["s", "t"]), "resample-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    one = F.lit(1.0)
    ratio = ((F.col("t") + one) * (F.lit(all_s) + one * buckets)) / ((F.col("s") + one) * (F.lit(all_t) + one * buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from 32 bits of the SHA-256 of ``seed:doc_id``; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    order: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``, drawn towards ``target``.

    ``docs`` has doc_id and text, ``target`` text; other columns of either aren't read. Features are
    all runs of 1 to ``order`` words, repeats counted. Of the N rows with ``least_words`` words or more,
    the floor(``percent`` * N / 100) highest scores are drawn; rank (from 1) is null for all others.

    Ties of scores go to the smaller doc_id, nulls last, then by weight and n_features. A null or empty
    text has no features and a weight of 0. Rows are kept one for one: repeated rows and ids have a row
    and a rank each. Empty tables count nothing: without a target, gains follow the corpus alone. A
    text has to fit into a task; it is read whole. The gains, one a bucket, are what is broadcast.
    """
    rows = docs.select("doc_id", "text").withColumn("id", F.monotonically_increasing_id())
    table = settle(positions(rows, order, buckets), "resample-positions")
    sought = positions(target.select("text").withColumn("id", F.monotonically_increasing_id()), order, buckets)
    gain = settle(gains(counted(table, order, "s"), counted(sought, order, "t"), buckets), "resample-gains")
    scored = table
    for k in range(1, order + 1):
        own = F.broadcast(gain.select(F.col("bucket").alias(f"bucket_{k}"), F.col("gain").alias(f"gain_{k}")))
        scored = scored.join(own, f"bucket_{k}", "left")
    each = [f"{{}}_{k}" for k in range(1, order + 1)]
    sums = scored.groupBy("id").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("bucket_1").alias("n_words"),
        F.sum(sum((F.col(c.format("bucket")).isNotNull().cast("long") for c in each), F.lit(0))).alias("n_features"),
        F.sum(sum((F.coalesce(c.format("gain"), F.lit(0)) for c in each), F.lit(0))).alias("gain"),
    )
    mean = F.expr("(gain - pmod(gain, n_features)) div n_features")  # rounds down, without a detour by doubles
    sums = sums.withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(0))
    sums = sums.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    sums = settle(sums, "resample-scores")
    able = sums.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order_by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    placed = numbered(able, order_by, "place", "resample-order")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    rest = sums.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(*sums.columns, rank.alias("rank")).unionByName(rest)
