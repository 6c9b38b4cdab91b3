"""A Markdown report per document, built from arrays of lines inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators.validate import REQUIRED_FIELDS

ICONS = {"info": "ℹ", "warning": "⚠", "error": "✗"}


def _lines(*parts) -> Column:
    return F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def markdown(reports: DataFrame, rendered_at: str) -> DataFrame:
    """session_id, markdown: of validated documents; ``rendered_at`` is the time that the report shows."""
    named = F.get(F.filter("form_fields", lambda f: F.contains(F.lower(f["key"]), F.lit("first name"))), F.lit(0))["value"]
    title = F.when(F.coalesce(named, F.lit("")) != "", F.concat(F.lit("# Loan Application — "), named)).otherwise(F.lit("# Loan Application"))
    hand = F.when(F.col("has_handwriting"), F.concat(F.lit("Yes — pages "), T.python_list(F.col("handwriting_pages")))).otherwise(F.lit("No"))
    empty = F.array().cast("array<string>")
    rule = ["", "---", ""]
    head = _lines(
        title,
        "",
        F.concat(F.lit("**Session:** `"), F.col("session_id"), F.lit("`  ")),
        f"**Extracted:** {rendered_at}  ",
        F.concat(F.lit("**Pages:** "), F.col("total_pages").cast("string"), F.lit("  ")),
        F.concat(F.lit("**Overall Confidence:** "), T.fixed(F.col("overall_avg_confidence"), 1), F.lit("%  ")),
        F.concat(F.lit("**Handwriting Detected:** "), hand, F.lit("  ")),
        F.concat(F.lit("**Validation:** "), F.when(F.col("passed"), "PASS").otherwise("FAIL")),
        *rule,
    )
    told = F.coalesce(F.col("cleaning_notes"), empty)
    notes = F.when(F.size(told) == 0, empty).otherwise(
        F.concat(_lines("## Cleaning Notes", ""), F.transform(told, lambda n: F.concat(F.lit("- "), n)), _lines(*rule))
    )

    def issue(i: Column) -> Column:
        icon = F.create_map(*[F.lit(x) for pair in ICONS.items() for x in pair])[i["severity"]]
        page = F.when(F.coalesce(i["page"], F.lit(0)) != 0, F.concat(F.lit(" (page "), i["page"].cast("string"), F.lit(")"))).otherwise("")
        field = F.when(F.coalesce(i["field"], F.lit("")) != "", F.concat(F.lit(" [field: "), i["field"], F.lit("]"))).otherwise("")
        return F.concat(F.lit("- "), icon, F.lit(" **"), i["code"], F.lit("**"), page, field, F.lit(": "), i["message"])

    issues = F.when(F.size("issues") == 0, _lines("No issues found.")).otherwise(F.transform("issues", issue))
    titles = F.create_map(*[F.lit(x) for n, _ in REQUIRED_FIELDS for x in (n, T.title_of(n))])

    def row(*cells) -> Column:
        out = [F.lit("| ")]
        for k, c in enumerate(cells):
            out += [F.lit(" | ")] * (k > 0) + [c]
        return F.concat(*out, F.lit(" |"))

    found = F.transform(F.array_sort(F.map_entries("required_found")), lambda e: row(titles[e["key"]], e["value"]))
    missing = F.transform("required_missing", lambda n: row(titles[n], F.lit("⚠ Not found")))

    def field(f: Column) -> Column:
        marks = F.array_compact(
            F.array(
                F.when(f["is_truncated"], F.lit("⚠ truncated")),
                F.when(f["original_value"].isNotNull(), F.concat(F.lit("normalised from `"), f["original_value"], F.lit("`"))),
            )
        )
        value = F.when(f["value"] == "", F.lit("_empty_")).otherwise(f["value"])
        return row(f["page"].cast("string"), f["key"], value, F.array_join(marks, ", "))

    def table(t: Column, i: Column) -> Column:
        size = [F.lit("### Table "), (i + 1).cast("string"), F.lit(" — Page "), t["page"].cast("string"), F.lit(" ("), t["rows"].cast("string"), F.lit(" rows × "), t["cols"].cast("string"), F.lit(" cols)")]
        body = T.grid_markdown(t["data"])
        return F.array(F.concat(*size), F.lit(""), F.when(body == "", F.lit("_No cell content extracted._")).otherwise(body), F.lit(""))

    tables = empty
    if "tables" in reports.columns:
        own = F.concat(_lines("## Tables", ""), F.flatten(F.transform("tables", table)), _lines("---", ""))
        tables = F.when(F.coalesce(F.size("tables"), F.lit(0)) > 0, own).otherwise(empty)

    def page(p: Column) -> Column:
        hand = F.when(p["has_handwriting"], F.lit(" _(contains handwriting)_")).otherwise("")
        start = F.concat(F.lit("### Page "), p["page_number"].cast("string"), hand, F.lit(" — confidence: "), T.fixed(p["avg_confidence"], 1), F.lit("%"))
        return F.array(start, F.lit(""), p["text"], F.lit(""))

    whole = F.concat(
        head,
        notes,
        _lines("## Validation Report", ""),
        issues,
        _lines(*rule, "## Key Loan Fields", "", "| Field | Value |", "|---|---|"),
        found,
        missing,
        _lines(*rule, "## All Form Fields", "", "| Page | Field | Value | Notes |", "|---|---|---|---|"),
        F.transform("form_fields", field),
        _lines(*rule),
        tables,
        _lines("## Full Text", ""),
        F.flatten(F.transform("pages", page)),
    )
    return reports.select("session_id", F.array_join(whole, "\n").alias("markdown"))
