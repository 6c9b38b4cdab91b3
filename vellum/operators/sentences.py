"""Sentences with learned abbreviations, after Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006).

A full stop ends a sentence unless it belongs to an abbreviation, an initial or an ordinal. Which words
are abbreviations is learned from the corpus: a likelihood ratio tells how much a word keeps company
with full stops, weighed by how short it is, how many inner stops it has and how often it stands without
one. Which words start sentences is learned from what follows other stops; such a word ends a sentence
behind an abbreviation too. Counts are aggregated in Spark and joined to the places in question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.sources.workspace import settle

# ---- fixed values: thresholds of the method ------------------------------------------------------
ABBREVIATION, STARTER, BOUND = 0.3, 30.0, 0.99
# ---------------------------------------------------------------------------------------------------

#: A word's own form: lower-cased, without signs around it, a full stop at its end kept.
EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$"


def own_form(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), EDGES, "")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _plain(form: Column) -> Column:
    return F.regexp_replace(form, r"\.$", "")


def forms(docs: DataFrame) -> DataFrame:
    """form, n_with and n_without: how often each word stands with and without a full stop. Words are counted as they are written before they get their form."""
    written = docs.select(F.explode(_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    form = own_form(F.col("word"))
    own = written.select(_plain(form).alias("form"), form.endswith(".").alias("stop"), "n")
    some = lambda stop: F.sum(F.when(stop, F.col("n")).otherwise(0))
    return own.groupBy("form").agg(some(F.col("stop")).alias("n_with"), some(~F.col("stop")).alias("n_without"))


def breaks(docs: DataFrame) -> DataFrame:
    """form, stop, next and n: how often a word that may end a sentence (stop: by a full stop) is followed by which other one. A text's words are paired inside its row."""
    own = docs.select(_words(F.col("text")).alias("w"))
    paired = F.filter(F.transform("w", lambda x, i: F.when(x.rlike(r"[.!?]$"), F.struct(x.alias("word"), F.get("w", i + 1).alias("after")))), lambda p: p.isNotNull())
    written = own.select(F.inline(paired)).where("after IS NOT NULL").groupBy("word", "after").agg(F.count(F.lit(1)).alias("n"))
    form = own_form(F.col("word"))
    told = written.select(_plain(form).alias("form"), form.endswith(".").alias("stop"), _plain(own_form(F.col("after"))).alias("next"), "n")
    return told.where("next <> ''").groupBy("form", "stop", "next").agg(F.sum("n").alias("n"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """form, n_with, n_without, score and is_abbreviation of every form with a letter that stands before a stop; ``counts`` are ``forms``."""
    # one row
    total, stops = counts.agg(F.sum(F.col("n_with") + F.col("n_without")), F.sum("n_with")).first()
    if not stops:
        total, stops = 1, 0
    p = min(max(stops / total, 1e-12), 1 - 1e-12)
    a, b = F.col("n_with"), F.col("n_without")
    ratio = -2 * (a * F.ln(F.lit(p)) + b * F.ln(F.lit(1 - p)) - a * F.ln(F.lit(BOUND)) - b * F.ln(F.lit(1 - BOUND)))
    inner = F.regexp_count("form", F.lit(r"\."))
    size = (F.length("form") - inner).cast("double")
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size, -b.cast("double"))
    own = counts.where((a > 0) & F.col("form").rlike(r"\p{L}")).withColumn("raw", score)
    return own.select("form", "n_with", "n_without", T.rounded(F.col("raw"), 2).alias("score"), (F.col("raw") >= ABBREVIATION).alias("is_abbreviation"))


def starters(pairs: DataFrame, counts: DataFrame, known: DataFrame) -> DataFrame:
    """form, n, n_first and score of the words that stand behind stops more often than chance has it.

    ``pairs`` are ``breaks``, ``counts`` ``forms`` and ``known`` the ``abbreviations``; what follows theirs doesn't count.
    """
    short = known.where("is_abbreviation").select("form", F.lit(True).alias("short"))
    broken = pairs.join(short, "form", "left").where(~F.col("stop") | F.col("short").isNull() & ~F.col("form").rlike(r"^\p{L}$"))
    first = settle(broken.groupBy(F.col("next").alias("form")).agg(F.sum("n").alias("n_first")), "sentence-firsts")
    total = counts.agg(F.coalesce(F.sum(F.col("n_with") + F.col("n_without")), F.lit(0))).first()[0]
    breaks = first.agg(F.coalesce(F.sum("n_first"), F.lit(0))).first()[0]
    every = counts.select("form", (F.col("n_with") + F.col("n_without")).alias("n"))
    both = first.join(every, "form").where(F.col("form").rlike(r"\p{L}"))
    ab, b = F.col("n_first").cast("double"), F.col("n").cast("double")
    a, n = F.lit(float(breaks)), F.lit(float(total))

    def term(k: Column, m: Column, q: Column) -> Column:
        """k successes and m failures at the rate q, as a logarithm; nothing happens at the rate 0 or 1."""
        return F.when((q <= 0) | (q >= 1), F.lit(0.0)).otherwise(k * F.ln(q) + m * F.ln(1 - q))

    p, p1, p2 = b / n, F.try_divide(ab, a), F.try_divide(b - ab, n - a)
    ratio = -2 * (term(ab, a - ab, p) + term(b - ab, n - a - b + ab, p) - term(ab, a - ab, p1) - term(b - ab, n - a - b + ab, p2))
    own = both.withColumn("raw", ratio).where((ab * n > b * a) & (F.col("raw") >= STARTER))
    return own.select("form", "n", "n_first", T.rounded(F.col("raw"), 2).alias("score"))


def learn(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(abbreviations, starters) of all texts of ``docs`` (doc_id, text)."""
    counts = settle(forms(docs), "word-forms")
    known = settle(abbreviations(counts), "abbreviations")
    return known, settle(starters(breaks(docs), counts, known), "starters")


def split(docs: DataFrame, known: DataFrame, first: DataFrame) -> DataFrame:
    """doc_id and sentences of every text with any, by learned ``abbreviations`` and ``starters``.

    Places where white space follows . ! or ? are looked at. After ! and ? a sentence ends. After a
    stop it ends too, but not behind an abbreviation or a single letter, unless a known starter with a
    capital follows, and not between a number and a small letter. Pieces of one sentence are joined by
    one space. doc_id is unique; null and blank texts have no row.
    """
    own = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "piece")).where(T.strip(F.col("piece")) != "")
    last, begin = F.regexp_extract("piece", r"(\S+)\s*$", 1), F.regexp_extract("piece", r"^\s*(\S+)", 1)
    by = Window.partitionBy("doc_id").orderBy("pos")
    told = own.select(
        "doc_id", "pos", "piece", last.endswith(".").alias("stop"), F.regexp_replace(own_form(last), r"\.$", "").alias("form"), F.lead(begin).over(by).alias("next")
    ).withColumn("next_form", F.regexp_replace(own_form(F.col("next")), r"\.$", ""))
    # written by themselves, they are as small as they look, and the texts' pieces aren't shuffled by them
    short = settle(known.where("is_abbreviation").select("form", F.lit(True).alias("short")), "short-forms")
    starts = first.select(F.col("form").alias("next_form"), F.lit(True).alias("starts"))
    told = told.join(short, "form", "left").join(starts, "next_form", "left")
    small = F.col("next").rlike(r"^[^\p{L}\p{N}]*\p{Ll}")
    short_one = F.col("short").isNotNull() | F.col("form").rlike(r"^\p{L}$")
    goes_on = F.col("stop") & F.when(short_one, F.col("starts").isNull() | small).otherwise(F.col("form").rlike(r"^\p{N}+$") & small)
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    told = told.withColumn("sentence", F.coalesce(F.sum(F.when(goes_on, 0).otherwise(1)).over(upto), F.lit(0)))
    joined = told.groupBy("doc_id", "sentence").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    joined = joined.select("doc_id", "sentence", F.array_join(F.transform("p", lambda x: x["piece"]), " ").alias("text"))
    return joined.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sentence", "text"))).alias("s")).select("doc_id", F.transform("s", lambda x: x["text"]).alias("sentences"))
