"""Chunks of documents: overlapping sentence windows, token-greedy chunks, offsets and page references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T


def _sentences(docs: DataFrame) -> Column:
    """Those of a column ``sentences``, as learned abbreviations give them, else the text cut after each . ! or ?"""
    return F.col("sentences") if "sentences" in docs.columns else T.sentences(F.col("text"))


def sentence_chunks(docs: DataFrame, size: int = 4, step: int = 2) -> DataFrame:
    """doc_id, chunk_id, text, n_sentences: windows of ``size`` sentences, each ``step`` after the last.

    A window that begins in the text is a chunk, the last ones may be shorter. One row at a time.
    """
    own = docs.select("doc_id", _sentences(docs).alias("s")).where(F.size("s") > 0)
    starts = F.sequence(F.lit(0), F.size("s") - 1, F.lit(step))
    own = own.select("doc_id", "s", F.posexplode(starts).alias("chunk_id", "at"))
    part = F.slice("s", F.col("at") + 1, F.lit(size))
    return own.select("doc_id", "chunk_id", F.array_join(part, " ").alias("text"), F.size(part).alias("n_sentences"))


def token_chunks(docs: DataFrame, most: int = 400, overlap: int = 80, least: int = 50) -> DataFrame:
    """doc_id, chunk_id, text, token_count: whole sentences up to ``most`` tokens, the next chunk starting
    with the last sentences of up to ``overlap`` tokens; chunks below ``least`` tokens are left out.

    The running state, which is three numbers and the chunks' bounds, is folded over a document's
    sentences inside one row; tokens are words.
    """
    own = docs.select("doc_id", _sentences(docs).alias("s")).where(F.size("s") > 0)
    own = own.withColumn("n", F.transform("s", T.word_count))
    bounds = "array<struct<first:int,last:int,tokens:int>>"
    state = F.struct(F.array().cast(bounds).alias("done"), F.lit(1).alias("first"), F.lit(0).alias("tokens"))

    def told(a: Column, i: Column) -> Column:
        """The chunk that ends before sentence i."""
        return F.struct(a["first"].alias("first"), (i - 1).alias("last"), a["tokens"].alias("tokens"))

    def begin(a: Column, i: Column, n: Column) -> Column:
        """A new chunk with sentence i, behind as many of the last sentences as fit the overlap."""
        last = F.reverse(F.slice("n", a["first"], i - a["first"]))

        def back(b: Column, x: Column) -> Column:
            fits = b["on"] & (b["tokens"] + x <= overlap)
            return F.struct((b["kept"] + fits.cast("int")).alias("kept"), F.when(fits, b["tokens"] + x).otherwise(b["tokens"]).alias("tokens"), fits.alias("on"))

        def over(b: Column) -> Column:
            alone = b["tokens"] + n > most
            return F.struct(
                F.concat(a["done"], F.array(told(a, i))).alias("done"),
                F.when(alone, i).otherwise(i - b["kept"]).alias("first"),
                F.when(alone, n).otherwise(b["tokens"] + n).alias("tokens"),
            )

        return F.aggregate(last, F.struct(F.lit(0).alias("kept"), F.lit(0).alias("tokens"), F.lit(True).alias("on")), back, over)

    def step(a: Column, i: Column) -> Column:
        n = F.get(F.col("n"), i - 1)
        more = F.struct(a["done"].alias("done"), a["first"].alias("first"), (a["tokens"] + n).alias("tokens"))
        return F.when((i > a["first"]) & (a["tokens"] + n > most), begin(a, i, n)).otherwise(more)

    chunks = F.aggregate(F.sequence(F.lit(1), F.size("n")), state, step, lambda a: F.concat(a["done"], F.array(told(a, F.size("n") + 1))))
    out = own.select("doc_id", "s", F.posexplode(chunks).alias("chunk_id", "c")).where(F.col("c.tokens") >= least)
    text = F.array_join(F.slice("s", F.col("c.first"), F.col("c.last") - F.col("c.first") + 1), " ")
    return out.select("doc_id", "chunk_id", text.alias("text"), F.col("c.tokens").alias("token_count"))


def with_offsets(chunks: DataFrame) -> DataFrame:
    """``chunks`` with char_start and char_end, as if a document's chunks were joined by one character."""
    before = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0))
    return chunks.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.length("text"))


def page_refs(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with page_ref: the last page (doc_id, page, page_start) that starts at or before char_start.

    An as-of join: marks and chunks are sorted together once, and each chunk takes the last mark before it
    as the rows stream by, so a document of many pages costs no more than its rows. Of marks at one place
    the highest page counts; a chunk before all marks of its document, or without any, has a null page_ref.
    """
    own = [F.col(f"`{c}`") for c in chunks.columns]
    page, at = pages.schema["page"].dataType, F.col("char_start").cast("long")
    marks = pages.select("doc_id", F.col("page_start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("page").alias("_page"), F.lit(None).cast(chunks.schema).alias("_chunk"))
    told = chunks.select("doc_id", at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(page).alias("_page"), F.struct(*own).alias("_chunk"))
    upto = Window.partitionBy("doc_id").orderBy("_at", "_kind", "_page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = marks.unionByName(told).withColumn("_last", F.last("_page", ignorenulls=True).over(upto))
    return both.where("_kind = 1").select(*[F.col("_chunk")[c].alias(c) for c in chunks.columns], F.col("_last").alias("page_ref"))
