"""Cleaning of fields, pages and tables, and the notes that tell what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.extract import first_per


def clean_fields(fields: DataFrame, strict: bool = False) -> DataFrame:
    """Fields without empty checkboxes, their values cleaned; ``original_value`` only where it changed."""
    return tidied(fields, strict).where(~F.col("is_box")).drop("is_box")


def tidied(fields: DataFrame, strict: bool = False) -> DataFrame:
    """All fields as ``clean_fields`` gives them, empty checkboxes too, which ``is_box`` tells."""
    own = fields.select("session_id", "ord", T.strip(F.col("key")).alias("key"), T.strip(F.col("value")).alias("raw"), "page", F.col("value_confidence").alias("confidence"))
    own = own.withColumn("value", T.clean_stripped(F.col("raw")))
    return own.select(
        "session_id",
        "ord",
        "key",
        "value",
        "page",
        "confidence",
        T.is_truncated(F.col("value"), strict).alias("is_truncated"),
        F.when(F.col("value") != F.col("raw"), F.col("raw")).alias("original_value"),
        T.stripped_checkbox(F.col("key"), F.col("raw")).alias("is_box"),
    )


def dedup_fields(cleaned: DataFrame) -> DataFrame:
    """One field per session, key and page: any value before none, then the surest value, then the first."""
    filled = F.col("value") != ""
    order = [filled.desc(), F.when(filled, F.col("confidence")).desc_nulls_last(), F.col("ord")]
    return first_per(cleaned, ["session_id", "key", "page"], order)


def field_part() -> Column:
    """A row of ``tidied`` as a struct whose order is that of ``dedup_fields`` within (page, key); null where that leaves the row out."""
    filled = F.col("value") != ""
    sure = F.when(filled, F.col("confidence"))
    # as in ORDER BY ... DESC NULLS LAST, where NaN is above all numbers
    kind = F.when(sure.isNull(), 2).when(F.isnan(sure), 0).otherwise(1)
    rank = F.struct(F.when(filled, 0).when(~filled, 1).otherwise(2).alias("empty"), kind.alias("kind"), (-sure).alias("unsure"), F.col("ord"))
    return F.when(~F.col("is_box"), F.struct("page", "key", rank.alias("rank"), "value", "confidence", "is_truncated", "original_value"))


def dedup_parts(parts: Column) -> Column:
    """A session's fields as ``dedup_fields`` leaves them, of an array of ``field_part``, in order of page and key."""

    def first(own: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.get(own, i - 1)
            return (i > 0) & x["key"].eqNullSafe(before["key"]) & x["page"].eqNullSafe(before["page"])

        return F.filter(own, lambda x, i: ~again(x, i))

    names = ("page", "key", "value", "confidence", "is_truncated", "original_value")
    return F.transform(T.let(F.sort_array(parts), first), lambda x: F.struct(*[x[n].alias(n) for n in names]))


def clean_pages(pages: DataFrame) -> DataFrame:
    """Pages without noise lines, and how many went."""
    rest = [c for c in pages.columns if c != "text"]
    own = pages.withColumn("_own", T.without_noise(F.col("text")))
    return own.select(*rest, F.col("_own.text").alias("text"), F.col("_own.lines_removed").alias("lines_removed"))


def notes_of(gone: Column, cut: Column, changed: Column) -> Column:
    """The notes of lines that went, fields (page, key) that are cut in order, and values that changed."""
    named = F.array_join(F.transform(cut, lambda x: F.concat(x["key"], F.lit(" (p"), x["page"].cast("string"), F.lit(")"))), ", ")
    return F.array_compact(
        F.array(
            F.when(gone > 0, F.concat(F.lit("Removed "), gone.cast("string"), F.lit(" repeated header/footer lines across all pages."))),
            F.when(F.size(cut) > 0, F.concat(F.size(cut).cast("string"), F.lit(" field(s) appear truncated: "), named)),
            F.when(changed > 0, F.concat(changed.cast("string"), F.lit(" field value(s) normalised (number spacing, digit-letter concat)."))),
        )
    )


def notes(pages: DataFrame, fields: DataFrame) -> DataFrame:
    """session_id, cleaning_notes: up to three sentences in a fixed order, of cleaned pages and fields."""
    lines = pages.groupBy("session_id").agg(F.sum("lines_removed").alias("gone"))
    cut = F.sort_array(F.collect_list(F.when(F.col("is_truncated"), F.struct("page", "key"))))
    counts = fields.groupBy("session_id").agg(cut.alias("cut"), F.count("original_value").alias("changed"))
    both = lines.join(counts, "session_id", "full_outer")
    gone, changed, cut = F.coalesce("gone", F.lit(0)), F.coalesce("changed", F.lit(0)), F.col("cut")
    return both.select("session_id", notes_of(gone, cut, changed).alias("cleaning_notes"))


def repeated_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, line, n: stripped lines that a document holds ``least`` times or more."""
    line = docs.select("doc_id", F.explode(F.transform(T.lines(F.col("text")), T.strip)).alias("line")).where("line <> ''")
    return line.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def strip_repeated(docs: DataFrame, least: int = 3) -> DataFrame:
    """Documents without lines that they hold ``least`` times or more; works on one row at a time."""
    own = docs.withColumn("_lines", T.lines(F.col("text")))
    own = own.withColumn("_own", F.transform("_lines", T.strip))
    # few texts repeat a line at all; only those count theirs
    some = F.size("_lines") - F.size(F.array_distinct("_own")) >= least - 1
    own = own.withColumn("_sorted", F.when(some, F.array_sort(F.filter("_own", lambda x: x != ""))))
    often = F.array_distinct(F.filter(F.col("_sorted"), lambda x, i: F.get(F.col("_sorted"), i + (least - 1)) == x))
    own = own.withColumn("_often", F.map_from_entries(F.transform(often, lambda x: F.struct(x, F.lit(True)))))
    kept = F.filter("_lines", lambda x: ~F.map_contains_key(F.col("_often"), T.strip(x)))
    text = F.when(F.size("_often") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))
    return own.withColumn("text", text).select(*docs.columns)


def clean_text(docs: DataFrame, watch: Callable[[str, DataFrame], DataFrame] = lambda stage, rows: rows) -> DataFrame:
    """The whole chain: repeated lines, white space, hyphens, typographic marks, tables as prose, page markers.

    ``watch`` sees each stage's rows, as ``Counters.watch`` does, and gives them back.
    """
    rest = [c for c in docs.columns if c != "text"]
    own = watch("repeated_lines", strip_repeated(watch("input", docs)))
    own = watch("marks", own.select(*rest, T.plain_marks(T.join_hyphens(T.collapse_space(F.col("text")))).alias("text")))
    own = watch("table_prose", own.select(*rest, T.table_prose(F.col("text")).alias("text")))
    return watch("page_markers", own.select(*rest, T.without_page_markers(F.col("text")).alias("text")))


def gate(docs: DataFrame, pages: str = "page_count", least_chars: int = 500, most_odd: float = 0.35, least_keywords: int = 2) -> DataFrame:
    """What may go on: errors and warnings of the text layer's checks, and the counts behind them."""
    own = docs.select(
        "doc_id",
        F.length(T.strip(F.col("text"))).alias("char_count"),
        T.gibberish_ratio(F.col("text")).alias("gibberish_ratio"),
        F.col(pages).alias("page_count"),
        T.keywords_found(F.col("text")).alias("keywords"),
        "lang",
    )
    errors = F.array_compact(
        F.array(
            F.when(F.col("char_count") < least_chars, F.lit("too_short")),
            F.when(F.col("gibberish_ratio") > most_odd, F.lit("garbled")),
            F.when(F.col("page_count") == 0, F.lit("no_pages")),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.size("keywords") < least_keywords, F.lit("not_a_loan")),
            F.when(F.col("lang") != "en", F.concat(F.lit("language:"), F.col("lang"))),
        )
    )
    return own.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("passed", F.size("errors") == 0)
