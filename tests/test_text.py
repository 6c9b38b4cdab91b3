"""Scalar functions: literal cases, and random strings against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import serving as S
from vellum.functions import text as T


def values(spark, rows, change):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(change(F.col("s"))).collect()]


NUMBERS = {
    "110 000": "110000", "55 00 000": "5500000", "50 000": "50000", "15 000.": "15000", "1,50,000": "1,50,000", "7,50,000": "7,50,000",
    "": "", "abc 1 2": "abc 1 2", "1 2 3 4": "1234", "..": "", " 5 ": "5", "12.50": "12.50", "1 ,2": "1 ,2", "3 . 4": "3 . 4",
}


def test_numbers(spark):
    assert values(spark, NUMBERS, T.clean_number) == list(NUMBERS.values())


def test_numbers_twice_is_once(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choice("0123 ,.") for _ in range(rng.randint(0, 12))) for _ in range(500)]
    once = values(spark, rows, T.clean_number)

    def model(v):
        if re.fullmatch(r"[\d\s,.]+", v):
            v = v.rstrip(".")
            for _ in range(2):
                v = re.sub(r"(\d)\s+(\d)", r"\1\2", v)
        return v.strip()

    assert once == [model(r) for r in rows]
    assert values(spark, once, T.clean_number) == [model(r) for r in once]


def test_digits_and_letters(spark):
    cases = {"36MONTHS": "36 MONTHS", "3200PaLAKH": "3200 PaLAKH", "5L": "5L", "AABP14589M": "AABP14589M", "12ab": "12ab"}
    assert values(spark, cases, T.split_digits) == list(cases.values())


def test_truncation(spark):
    rows = ["15/02/200", "15/02/2001", "1/2/99", "FLOATING", "750000", "", "www.site.co", "7,50,000"]
    assert values(spark, rows, T.is_truncated) == [True, False, True, True, False, False, True, False]
    assert values(spark, rows, lambda c: T.is_truncated(c, strict=True)) == [True, False, True, False, False, False, False, False]


def test_noise_lines(spark):
    rows = ["S", " S ", "s", "SHINHAN bank", "India", "india.", "Extend your financial NETWORK now", "Name"]
    assert values(spark, rows, T.is_noise_line) == [True, True, False, True, True, False, True, False]


def test_strip_is_unicode(spark):
    rows = [f"{c}x{c}" for c in "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0     　​"]
    assert values(spark, rows, T.strip) == [r.strip() for r in rows]


def test_rounding_follows_python(spark):
    rng = random.Random(5)
    nums = [rng.randint(0, 100000) / 1000 for _ in range(2000)] + [0.125, 2.675, 57.666666]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(nums)], "i int, x double").orderBy("i")
    assert [r[0] for r in df.select(T.rounded(F.col("x"))).collect()] == [round(x, 2) for x in nums]
    assert [r[0] for r in df.select(T.fixed(F.col("x"), 1)).collect()] == [f"{x:.1f}" for x in nums]


def test_whole_text_cleaning(spark):
    rows = ["a\n\n\n\nb  \t c ", "mort-\ngage", "“x” – it’s\xa05", "=== PAGE 12 ===\nrest", "no change"]
    assert values(spark, rows, T.collapse_space)[0] == "a\n\nb c"
    assert values(spark, rows, T.join_hyphens)[1] == "mortgage"
    assert values(spark, rows, T.plain_marks)[2] == "\"x\" - it's 5"
    assert values(spark, rows, T.without_page_markers)[3] == "rest"


def test_tables_and_prose(spark):
    assert values(spark, ["a | b | c", "a\tb\tc", "a | b", "plain"], T.is_table_line) == [True, True, False, False]
    told = values(spark, ["Principal | Rate | Term\n$250,000 | 4.5% | 30 years", "plain"], lambda c: T.table_prose(c, "Loan details: "))
    assert told == ["Loan details: Principal $250,000, Rate 4.5%, Term 30 years.", "plain"]


def test_gibberish_and_keywords(spark):
    assert values(spark, ["", "ab c", "@@@@ab"], T.gibberish_ratio) == [0.0, 0.0, pytest.approx(4 / 6)]
    assert values(spark, ["A LOAN for the lender"], T.keywords_found) == [["loan", "lender"]]


def test_intents(spark):
    cases = {
        " Summarize this": "summary", "What does clause 4 say": "explanation", "the EMI?": "finance", "premium": "retrieval", "a vs b": "comparison",
        "explain the emi": "explanation", "please summarize": "retrieval", "": "retrieval", "remind me of the premium emi": "finance",
    }
    cases["premium"] = "finance" if "emi" in "premium" else "retrieval"
    assert values(spark, cases, S.intent) == list(cases.values())


def test_parsing(spark):
    assert values(spark, ['{"f": 0.5}', "junk", '{"g": 1}', None], lambda c: S.judge_score(c, "f")) == [0.5, None, None, None]
    rows = ['data: {"choices":[{"delta":{"content":"hi"}}]}', "data: [DONE]", ": ping", ""]
    assert values(spark, rows, S.sse_delta) == ["hi", None, None, None]
    got = values(spark, ["sess_20250115_142305_ab", "sess_20250115_142305", "bad"], lambda c: S.session_started(c).cast("string"))
    assert got == ["2025-01-15 14:23:05", "2025-01-15 14:23:05", None]


def test_tables_in_text_become_prose(spark):
    from vellum.operators import tables

    texts = {
        1: "Loan terms\nPrincipal    Rate   Term\n$250,000     4.5%   30 years\n$7                  1 year\nend of it",
        2: "| a | b |c|\n|---|:-:|---|\n| 1 |  | 3 |\n\nx\ty\tz\n1\t2\t3\n4\t5\t6",
        3: "one  gap only\nand none here", 4: "a | b | c\n1 | 2", 5: "a | b | c\n1 | 2 | 3 | 4", 6: "no tables", 7: "", 8: None, 9: "|---|---|\n|---|---|",
        10: "Name  Value\nWide one  7",  # no column of blanks is common to both lines
    }
    docs = spark.createDataFrame([(k, t, 1) for k, t in texts.items()], "doc_id long, text string, run int")
    got = {r.doc_id: (r.text, r.n_rows) for r in tables.prose(docs).collect()}
    assert got == {
        1: ("Loan terms\nDetails: Principal $250,000, Rate 4.5%, Term 30 years.\nDetails: Principal $7, Rate, Term 1 year.\nend of it", 2),
        2: ("Details: a 1, b, c 3.\n\nDetails: x 1, y 2, z 3.\nDetails: x 4, y 5, z 6.", 3),
        **{k: (texts[k], 0) for k in (3, 4, 5, 6, 7, 8, 9, 10)},
    }
    assert tables.prose(docs.limit(0)).count() == 0


def test_stages_count_what_passes(spark):
    from vellum.operators import clean, counters

    docs = spark.createDataFrame([(1, "a\na\na\nb  c"), (2, None), (3, "")], "doc_id long, text string")
    seen = counters.Counters()
    out = clean.clean_text(docs, seen.watch).collect()
    assert [tuple(r) for r in seen.counts(spark).orderBy("seq").collect()] == [
        (0, "input", 3, 10), (1, "repeated_lines", 3, 4), (2, "marks", 3, 3), (3, "table_prose", 3, 3), (4, "page_markers", 3, 3)
    ] and sorted((r.doc_id, r.text) for r in out) == [(1, "b c"), (2, None), (3, "")]


def test_prose_takes_one_pass_without_a_shuffle(spark):
    from vellum.operators import tables

    docs = spark.createDataFrame([(1, "a  b\n1  2"), (1, "x\ty\tz\n1\t\t3\n\n|a|b|\n|-|-|\n| 1 ||")], "doc_id long, text string")
    out = tables.prose(docs)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    # rows of one doc_id are texts of their own
    assert sorted(tuple(r) for r in out.collect()) == [(1, "Details: a 1, b 2.", 1), (1, "Details: x 1, y, z 3.\n\nDetails: a 1, b.", 2)]
