"""Text functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------------------------
NOISE_LINE = "S"
NOISE_LINES_ANY_CASE = ("shinhan bank", "india")
NOISE_START_ANY_CASE = "extend your financial network"
CHECKBOX_KEYS = (
    "Male", "Female", "Transgender", "Single", "Married", "Divorced", "Widow", "Mr.", "Ms.", "M/s.", "Others",
    "S-Service", "B-Business", "O-Others", "Private Sector", "Public Sector", "Government Sector", "Professional",
    "Self Employed", "Retired", "Housewife", "Politician", "X-Not Categorised", "In-India", "Children", "Yes", "No",
    "Guarantor", "Photo",
)
LOAN_KEYWORDS = ("loan", "borrower", "lender", "interest", "principal", "repayment", "mortgage", "collateral", "emi", "amortization")
SMART_FROM, SMART_TO = "‘’“”–— ", "''\"\"-- "
PAGE_MARKER = r"=== PAGE \d+ ===\n?"
PAGE_BREAK = "\n\n--- Page Break ---\n\n"
TABLE_MARK = "\n\n[TABLE]\n"
LINE_ENDS, BLANK_RUNS = r"\n{3,}", r"[ \t]{2,}"
CUT_WORD = r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)"
CUT_DATE, CUT_LETTER = r"(?U)\d{1,2}/\d{1,2}/\d{2,3}\n?\z", r"[a-zA-Z]\n?\z"
# -----------------------------------------------------------------------------------------------

#: What Unicode-aware ``strip`` takes for white space, as a pattern and as the characters themselves.
_BLANK = r"[\s\x1c-\x1f]"
_NUMBER = r"(?U)^(?:\d|[\s\x1c-\x1f]|[,.])+\z"
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once however often the body names it, inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(rows: Column, key) -> Column:
    """A sorted array cut where ``key`` of its elements changes, as an array of arrays."""

    def cut(own: Column) -> Column:
        begins = F.transform(own, lambda x, i: F.when((i == 0) | ~key(x).eqNullSafe(key(F.get(own, i - 1))), i))
        return let(F.array_compact(begins), lambda at: F.transform(at, lambda b, j: F.slice(own, b + 1, F.coalesce(F.get(at, j + 1), F.size(own)) - b)))

    return let(rows, cut)


def strip(c: Column) -> Column:
    """Without white space at both ends, by Unicode."""
    return F.trim(c, F.lit(BLANKS))


def fixed(c: Column, places: int) -> Column:
    """A double as text with ``places`` decimals, ties to even on its exact value."""
    return F.call_function("format_number", c, F.lit("0." + "0" * places))


def rounded(c: Column, places: int = 2) -> Column:
    """A double rounded to ``places`` decimals, ties to even on its exact value."""
    return fixed(c, places).cast("double")


def clean_number(c: Column) -> Column:
    """Digits split by OCR are joined where the whole string is a number; commas stay, trailing dots go."""
    return strip(F.when(c.rlike(_NUMBER), _joined(c)).otherwise(c))


def _joined(number: Column) -> Column:
    return F.regexp_replace(F.rtrim(number, F.lit(".")), rf"(?U)(?<=\d){_BLANK}+(?=\d)", "")


def split_digits(c: Column) -> Column:
    """A digit before a capital and another letter gets a space: 36MONTHS, 36 MONTHS."""
    return F.regexp_replace(c, r"(?U)(\d)([A-Z][a-zA-Z])", "$1 $2")


def clean_stripped(c: Column) -> Column:
    """``clean_value`` of what is stripped already; no pattern is replaced where nothing can change."""
    odd = c.rlike(_NUMBER) & (c.endswith(".") | c.rlike(rf"(?U){_BLANK}"))
    own = F.when(odd, strip(_joined(c))).otherwise(c)
    return F.when(c.rlike(r"(?U)\d[A-Z][a-zA-Z]"), split_digits(c)).otherwise(own)


def clean_value(c: Column) -> Column:
    return clean_stripped(strip(c))


def is_truncated(c: Column, strict: bool = False) -> Column:
    """Ends like a date with too few digits or, unless ``strict``, in any ASCII letter."""
    dated = c.rlike(CUT_DATE)
    return dated if strict else dated | c.rlike(CUT_LETTER)


def is_noise_line(line: Column) -> Column:
    def told(own: Column, low: Column) -> Column:
        return (own == NOISE_LINE) | low.isin(*NOISE_LINES_ANY_CASE) | low.startswith(NOISE_START_ANY_CASE)

    return let(strip(line), lambda own: let(F.lower(own), lambda low: told(own, low)))


def without_noise(page: Column) -> Column:
    """A page's text without noise lines as ``text``, and how many went as ``lines_removed``."""

    def told(own: Column, kept: Column) -> Column:
        return F.struct(strip(F.array_join(kept, "\n")).alias("text"), (F.size(own) - F.size(kept)).cast("long").alias("lines_removed"))

    return let(lines(page), lambda own: let(F.filter(own, lambda x: ~is_noise_line(x)), lambda kept: told(own, kept)))


def is_empty_checkbox(key: Column, value: Column) -> Column:
    return stripped_checkbox(strip(key), strip(value))


def stripped_checkbox(key: Column, value: Column) -> Column:
    """``is_empty_checkbox`` of what is stripped already."""
    return (value == "") & key.isin(*CHECKBOX_KEYS)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def python_list(c: Column) -> Column:
    """An array of numbers written like [1, 2]."""
    return F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))


def title_of(name: str) -> str:
    """snake_case as Title Case."""
    return " ".join(p.capitalize() for p in name.split("_"))


def grid_text(grid: Column) -> Column:
    """A dense grid as text: cells joined by a bar, rows by a line end."""
    return F.array_join(F.transform(grid, lambda row: F.array_join(row, " | ")), "\n")


def grid_markdown(grid: Column) -> Column:
    """A dense grid as a Markdown table, its first row the header; bars in cells stay as they are."""

    def line(row: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))

    head = F.get(grid, F.lit(0))
    rule = line(F.transform(head, lambda x: F.lit("---")))
    body = F.transform(F.slice(grid, 2, F.greatest(F.size(grid), F.lit(1))), line)
    return F.when(F.size(grid) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.array(line(head), rule), body), "\n"))


def collapse_space(c: Column) -> Column:
    """At most two line ends in a row, one space for runs of blanks, nothing at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, LINE_ENDS, "\n\n"), BLANK_RUNS, " "))


def join_hyphens(c: Column) -> Column:
    """Words cut by a hyphen at a line end are joined."""
    return F.regexp_replace(c, CUT_WORD, "$1$2")


def plain_marks(c: Column) -> Column:
    """Typographic quotes, dashes and hard spaces as plain ones."""
    return F.translate(c, SMART_FROM, SMART_TO)


def without_page_markers(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_MARKER, "")


def is_table_line(line: Column) -> Column:
    """Two bars or more, or three columns by tabs."""
    return (F.regexp_count(line, F.lit(r"\|")) >= 2) | (F.size(F.split(line, "\t", -1)) >= 3)


def table_prose(c: Column, lead: str = "Details: ") -> Column:
    """Tables of a heading and one row as sentences: each heading with its value. Best effort.

    A table is two table lines of equally many cells (by bars or tabs) with no table line next to
    them; all other lines stay.
    """

    def told(head: Column, row: Column) -> Column:
        pairs = F.zip_with(F.split(head, r"[|\t]", -1), F.split(row, r"[|\t]", -1), lambda a, b: F.concat_ws(" ", F.trim(a), F.trim(b)))
        return F.concat(F.lit(lead), F.array_join(pairs, ", "), F.lit("."))

    def rewritten(own: Column, cells: Column) -> Column:
        """The lines ``own``, given how many cells each has (0: no table line)."""

        def at(i: Column, k: int) -> Column:
            return F.coalesce(F.get(cells, i + k), F.lit(0))

        def begins(i: Column, k: int) -> Column:
            """Whether a table of two lines begins ``k`` lines from line i."""
            return (at(i, k) > 0) & (at(i, k) == at(i, k + 1)) & (at(i, k - 1) == 0) & (at(i, k + 2) == 0)

        new = F.transform(own, lambda x, i: F.when(begins(i, 0), told(x, F.get(own, i + 1))).when(~begins(i, -1), x))
        return F.array_join(F.array_compact(new), "\n")

    def with_cells(own: Column) -> Column:
        return let(F.transform(own, lambda x: F.when(is_table_line(x), F.regexp_count(x, F.lit(r"[|\t]")) + 1).otherwise(0)), lambda cells: rewritten(own, cells))

    # most texts have no two table lines in a row, and are spared
    # tried at line starts only and without going back, so that long lines take one pass
    bars, tabs = r"[^\n|]*+\|[^\n|]*+\|[^\n]*+", r"[^\n\t]*+\t[^\n\t]*+\t[^\n]*+"
    return F.when(c.rlike(rf"(?m)^(?:{bars}|{tabs})\n(?:{bars}|{tabs})"), let(lines(c), with_cells)).otherwise(c)


def gibberish_ratio(c: Column) -> Column:
    """The share of characters that are neither letters, digits nor common marks; 0 for an empty text."""
    odd = F.length(F.regexp_replace(c, r"[\p{L}\p{N} .,!?\-:;()%$\n]", ""))
    return F.when(F.length(c) == 0, F.lit(0.0)).otherwise(odd / F.length(c))


def keywords_found(c: Column, keywords: tuple[str, ...] = LOAN_KEYWORDS) -> Column:
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(F.lower(c), k))


def sentences(c: Column) -> Column:
    """Cut after . ! or ? where white space follows."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(c: Column) -> Column:
    """Runs without white space: the default token counter."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
