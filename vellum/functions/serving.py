"""Functions of the question and answer side: vectors, intents, keys, costs and parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import strip

# ---- fixed values: intents in order of priority, with what marks them ---------------------------
SUMMARY_STARTS = ("summarize", "give me a summary", "overview")
EXPLANATION_MARKS = ("explain", "what does", "define")
FINANCE_MARKS = ("emi", "interest rate", "monthly payment", "principal amount", "repayment schedule")
COMPARISON_MARKS = ("difference", " vs ", "compare")
# -----------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector scaled to length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / size))


def intent(question: Column) -> Column:
    """The first intent whose marks the question holds; ``retrieval`` by default."""
    q = F.lower(strip(question))

    def any_of(marks, test):
        out = F.lit(False)
        for m in marks:
            out = out | test(m)
        return out

    return (
        F.when(any_of(SUMMARY_STARTS, q.startswith), "summary")
        .when(any_of(EXPLANATION_MARKS, q.contains), "explanation")
        .when(any_of(FINANCE_MARKS, q.contains), "finance")
        .when(any_of(COMPARISON_MARKS, q.contains), "comparison")
        .otherwise("retrieval")
    )


def variant(key: Column, share: int = 50) -> Column:
    """A or B, the same for a key in every session: the bucket of its MD5 below ``share`` percent."""
    bucket = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    return F.when(bucket < share, "A").otherwise("B")


def cache_key(session: Column, question: Column) -> Column:
    return F.md5(F.concat_ws(":", session, F.lower(strip(question))))


def composite(faithfulness: Column, relevance: Column) -> Column:
    return 0.6 * faithfulness + 0.4 * relevance


def cost(tokens: Column, price: float) -> Column:
    return tokens / 1000 * F.lit(price)


def judge_score(text: Column, name: str) -> Column:
    """A number out of a judge's JSON answer; null for garbage."""
    return F.from_json(text, f"{name} double")[name]


def sse_delta(line: Column) -> Column:
    """The text of a server-sent event; null for anything but a data frame, and for the end mark."""
    body = F.substring(line, 7, 1 << 30)
    return F.when(line.startswith("data: ") & (body != "[DONE]"), F.get_json_object(body, "$.choices[0].delta.content"))


def session_started(session: Column) -> Column:
    """The time in a session id of the form name_YYYYMMDD_HHMMSS_suffix."""
    found = F.regexp_extract(session, r"_(\d{8}_\d{6})(?:_|$)", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyyMMdd_HHmmss"))
