"""From OCR blocks to pages, tables, form fields and documents.

``blocks`` holds one row per block (session_id, ord, id, block_type, page, text, text_type, confidence,
row_index, col_index, entity_types, and relationships as edges in their own table), ``edges`` one row per
reference (session_id, src, rtype, rpos, ipos, dst). Order is data: every concatenation is sorted by the
positions that the input gave. References to missing blocks are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import graph

#: Exact sums of confidences: what is summed first must not matter.
EXACT = "decimal(38,12)"
LOW_CONFIDENCE = 80


def edges(blocks: DataFrame) -> DataFrame:
    """One row per reference of blocks that carry ``relationships``."""
    rel = blocks.select("session_id", F.col("id").alias("src"), F.posexplode("relationships").alias("rpos", "r"))
    return rel.select("session_id", "src", F.col("r.Type").alias("rtype"), "rpos", F.posexplode("r.Ids").alias("ipos", "dst"))


def pages(blocks: DataFrame) -> DataFrame:
    """One row per page that has a line or a word.

    Words are counted apart from lines, as they are many and their counts are combined before they are shuffled.
    """
    keys = ["session_id", "page_number"]
    own = blocks.withColumn("page_number", F.coalesce("page", F.lit(1)))
    confidence = F.coalesce("confidence", F.lit(0.0))
    words = own.where("block_type = 'WORD'").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"),
        F.sum(confidence.cast(EXACT)).cast("double").alias("total"),
        F.count_if(confidence < LOW_CONFIDENCE).alias("low_confidence_words"),
        F.bool_or(F.coalesce("text_type", F.lit("")) == "HANDWRITING").alias("has_handwriting"),
    )
    line = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))
    lines = own.where("block_type = 'LINE'").select(*keys, line.alias("line"))
    # dealt out by session, so that steps that gather a session's pages need no further shuffle; a page has one row of counts
    counts = ["word_count", "total", "low_confidence_words", "has_handwriting"]
    out = lines.unionByName(words, allowMissingColumns=True).repartition("session_id").groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda x: x["text"]), "\n").alias("text"), *[F.max(c).alias(c) for c in counts]
    ).fillna({"word_count": 0, "low_confidence_words": 0, "has_handwriting": False})
    average = F.when(F.col("word_count") > 0, F.col("total") / F.col("word_count")).otherwise(0.0)
    return out.select(
        "session_id", "page_number", "text", "word_count", T.rounded(average).alias("avg_confidence"), "low_confidence_words", "has_handwriting"
    )


def table_cells(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, table_ord, page, row, col, text, confidence, pos: the cells of tables, in order."""
    return cells_of(graph.parts(blocks, edges))


def cells_of(parts: DataFrame) -> DataFrame:
    """``table_cells`` of parts of block graphs."""

    def told(g: graph.Graph) -> dict:
        child, tables, cells = g.links("CHILD"), g.kind("TABLE"), g.kind("CELL")
        of, table = graph.meet(g.src[child], g.id[tables])
        again, cell = graph.meet(g.dst[child[of]], g.id[cells])
        links, owners, own = child[of[again]], g.blocks.take(pa.array(tables[table[again]])), g.blocks.take(pa.array(cells[cell]))
        return {
            "session_id": g.sessions_of(cells[cell]),
            "table_ord": owners["ord"],
            "page": owners["page"],
            "row": own["row_index"],
            "col": own["col_index"],
            "text": graph.looked_up(g.id[cells[cell]], *g.texts()),
            "confidence": own["confidence"],
            "rpos": g.edges["rpos"].take(pa.array(links)),
            "ipos": g.edges["ipos"].take(pa.array(links)),
        }

    out = graph.resolve(parts, told, f"session_id string, table_ord {graph.order_type(parts)}, page int, row int, col int, text string, confidence double, rpos int, ipos int")
    return out.fillna({"page": 1, "row": 0, "col": 0, "text": "", "confidence": 0.0}).select(
        "session_id", "table_ord", "page", "row", "col", "text", "confidence", F.struct("rpos", "ipos").alias("pos")
    )


def grids(cells: DataFrame, clean: bool = False) -> DataFrame:
    """session_id, table_ord, page, rows, cols, data: dense grids; of cells in one place the last stays."""
    own = T.clean_value(F.col("text")) if clean else F.col("text")
    cell = F.struct("row", "col", "pos", own.alias("text"))
    found = cells.groupBy("session_id", "table_ord", "page").agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    found = found.withColumn("_grid", grid(F.col("_cells")))
    return found.select("session_id", "table_ord", "page", *[F.col(f"_grid.{n}").alias(n) for n in ("rows", "cols", "data")])


def grid(cells: Column) -> Column:
    """A table's rows, cols and data, of the array of its cells in order of row, col and pos."""
    empty = F.array().cast("array<array<string>>")

    def dense(own: Column, rows: Column, cols: Column) -> Column:
        def number(r: Column, c: Column) -> Column:
            return r.cast("long") * (cols + 1) + c

        def last(x: Column, i: Column) -> Column:
            after = F.get(own, i + 1)
            return (x["row"] >= 1) & (x["col"] >= 1) & ((after["row"] != x["row"]) | (after["col"] != x["col"]) | after.isNull())

        at = F.map_from_entries(F.transform(F.filter(own, last), lambda x: F.struct(number(x["row"], x["col"]).alias("key"), x["text"].alias("value"))))

        def line(at: Column, r: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), cols), lambda c: F.coalesce(F.try_element_at(at, number(r, c)), F.lit("")))

        return F.when((rows < 1) | (cols < 1), empty).otherwise(T.let(at, lambda at: F.transform(F.sequence(F.lit(1), F.greatest(rows, F.lit(1))), lambda r: line(at, r))))

    def told(own: Column, size: Column) -> Column:
        rows, cols = size["rows"], size["cols"]
        return F.struct(rows.alias("rows"), cols.alias("cols"), dense(own, rows, cols).alias("data"))

    def most(own: Column, name: str) -> Column:
        return F.array_max(F.transform(own, lambda x: x[name]))

    return T.let(cells, lambda own: T.let(F.struct(most(own, "row").alias("rows"), most(own, "col").alias("cols")), lambda size: told(own, size)))


def grids_in(cells: Column) -> Column:
    """A session's ``grids`` of the array of its cells (table_ord, page, row, col, pos, text), in order of table and page."""

    def told(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        return T.let(grid(own), lambda g: F.struct(first["table_ord"].alias("table_ord"), first["page"].alias("page"), *[g[n].alias(n) for n in ("rows", "cols", "data")]))

    return F.transform(T.runs(F.sort_array(cells), lambda x: F.struct(x["table_ord"], x["page"])), told)


def pages_in(words: Column) -> Column:
    """A session's pages, in order, of the array of its words (page_number, confidence, has_handwriting): word_count, avg_confidence and has_handwriting."""

    def told(own: Column) -> Column:
        known = F.filter(F.transform(own, lambda w: w["confidence"].cast("decimal(37,12)")), lambda c: c.isNotNull())
        # 37 digits, as a sum of 38 would lose the last decimal place
        total = T.let(known, lambda k: F.when(F.size(k) > 0, F.aggregate(k, F.lit(0).cast(EXACT), lambda a, c: (a.cast("decimal(37,12)") + c).cast(EXACT))))
        return F.struct(
            F.get(own, F.lit(0))["page_number"].alias("page_number"),
            F.size(own).cast("long").alias("word_count"),
            T.rounded(total.cast("double") / F.size(own)).alias("avg_confidence"),
            F.exists(own, lambda w: w["has_handwriting"]).alias("has_handwriting"),
        )

    return F.transform(T.runs(F.sort_array(words), lambda w: w["page_number"]), told)


def form_fields(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """session_id, ord, key, value, key_confidence, value_confidence, page; the last resolvable value wins."""
    return fields_of(graph.parts(blocks, edges))


def fields_of(parts: DataFrame) -> DataFrame:
    """``form_fields`` of parts of block graphs."""

    def told(g: graph.Graph) -> dict:
        nodes, words = g.texts()
        entities = g.blocks["entity_types"]
        is_key = np.zeros(len(entities), bool)
        is_key[pc.list_parent_indices(entities).to_numpy()[np.asarray(pc.fill_null(pc.equal(entities.flatten(), "KEY"), False))]] = True
        keys = g.kind("KEY_VALUE_SET")
        keys = keys[is_key[keys]]
        keys = keys[np.isin(g.id[keys], nodes)]
        value = g.links("VALUE")
        of, target = graph.meet(g.dst[value], g.id)
        order = g.in_order(value[of])
        src, target = g.src[value[of[order]]], target[order]
        last = np.flatnonzero(np.append(src[1:] != src[:-1], len(src) > 0))
        src, target = src[last], target[last]
        own = g.blocks.take(pa.array(keys))
        return {
            "session_id": g.sessions_of(keys),
            "ord": own["ord"],
            "key": graph.looked_up(g.id[keys], nodes, words),
            "value": graph.looked_up(g.id[keys], src, graph.looked_up(g.id[target], nodes, words)),
            "kc": own["confidence"],
            "vc": graph.looked_up(g.id[keys], src, g.blocks["confidence"].take(pa.array(target))),
            "page": own["page"],
        }

    out = graph.resolve(parts, told, f"session_id string, ord {graph.order_type(parts)}, key string, value string, kc double, vc double, page int")
    out = out.fillna({"value": "", "kc": 0.0, "vc": 0.0, "page": 1}).withColumn("key", T.strip(F.col("key"))).where("key <> ''")
    return out.select(
        "session_id", "ord", "key", T.strip(F.col("value")).alias("value"), T.rounded(F.col("kc")).alias("key_confidence"), T.rounded(F.col("vc")).alias("value_confidence"), "page"
    )


def documents(pages: DataFrame, grids: DataFrame | None = None) -> DataFrame:
    """session_id, full_text, total_pages, overall_avg_confidence, has_handwriting."""
    ordered = F.sort_array(F.collect_list(F.struct("page_number", "text")))
    weighted = F.sum(F.col("avg_confidence").cast(EXACT) * F.col("word_count").cast("decimal(18,0)")).cast("double")
    out = pages.groupBy("session_id").agg(
        ordered.alias("pages"),
        F.count(F.lit(1)).alias("total_pages"),
        F.sum("word_count").alias("words"),
        weighted.alias("weighted"),
        F.bool_or("has_handwriting").alias("has_handwriting"),
    )
    section = lambda p: p["text"]
    if grids is not None:
        # joined by session, as the pages are together by then
        table = F.struct("page", "table_ord", T.grid_text(F.col("data")).alias("t"))
        out = out.join(grids.groupBy("session_id").agg(F.sort_array(F.collect_list(table)).alias("tables")), "session_id", "left")

        def section(p):
            own = F.transform(F.filter("tables", lambda t: t["page"] == p["page_number"]), lambda t: t["t"])
            return F.when(F.size(own) > 0, F.concat(p["text"], F.lit(T.TABLE_MARK), F.array_join(own, T.TABLE_MARK))).otherwise(p["text"])

    full = F.array_join(F.transform("pages", section), T.PAGE_BREAK)
    overall = F.when(F.col("words") > 0, F.col("weighted") / F.col("words")).otherwise(0.0)
    return out.select("session_id", full.alias("full_text"), "total_pages", T.rounded(overall).alias("overall_avg_confidence"), "has_handwriting")


def every_session(sessions: DataFrame, docs: DataFrame) -> DataFrame:
    """``docs`` with a row for each of ``sessions``; one without pages has no text and no confidence."""
    blank = {"full_text": "", "total_pages": 0, "overall_avg_confidence": 0.0, "has_handwriting": False}
    return sessions.join(docs, "session_id", "left").fillna(blank)


def table_counts(blocks: DataFrame) -> DataFrame:
    """session_id, n_tables: all TABLE blocks, those without cells too."""
    return blocks.where("block_type = 'TABLE'").groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tables"))


def marked_text(pages: DataFrame) -> DataFrame:
    """session_id, raw_text: a document's pages in order, each behind a marker of its number."""
    own = F.concat(F.lit("=== PAGE "), F.col("page_number").cast("string"), F.lit(" ===\n"), F.col("text"))
    ordered = F.sort_array(F.collect_list(F.struct("page_number", own.alias("t"))))
    return pages.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("raw_text"))


def block_histogram(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.coalesce("block_type", F.lit("UNKNOWN")).alias("block_type")).agg(F.count(F.lit(1)).alias("n_blocks"))


def page_profile(blocks: DataFrame, sample: int = 5) -> DataFrame:
    """Per page: words, mean confidence to one decimal, handwritten words and the first few of them.

    Counts are combined before they are shuffled; only handwritten words are collected.
    """
    keys = ["session_id", "page_number"]
    words = blocks.where("block_type = 'WORD'").withColumn("page_number", F.coalesce("page", F.lit(1)))
    hand = F.coalesce("text_type", F.lit("")) == "HANDWRITING"
    counts = words.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("word_count"),
        F.sum(F.coalesce("confidence", F.lit(0.0)).cast(EXACT)).cast("double").alias("total"),
        F.count_if(hand).alias("handwritten_words"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("ord", "text")))
    samples = words.where(hand).groupBy(*keys).agg(F.array_join(F.transform(F.slice(ordered, 1, sample), lambda x: x["text"]), " ").alias("handwriting_sample"))
    out = counts.join(samples, keys, "left").fillna({"handwriting_sample": ""})
    return out.select("session_id", "page_number", "word_count", T.rounded(F.col("total") / F.col("word_count"), 1).alias("avg_confidence"), "handwritten_words", "handwriting_sample")


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row per ``keys`` by ``order``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
