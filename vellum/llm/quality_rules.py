"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger stores what was measured and one failure bit per
rule; policies, each a versioned set of rules, are applied to the bits afterwards, and what a policy
would do without one of its rules is counted from the bits alone. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: ASCII white space, between words.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Rules in the order of their bits: name and failing condition over the ledger's measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
    "capitals": "100 * n_capitals > 50 * word_chars",
    "shouting": "100 * n_shouts > 30 * n_words",
    "few_letters": "100 * n_letters < 60 * word_chars",
}

#: Policies by version: the rules that block.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}
CURRENT = "v1"


def bits(names: tuple[str, ...] | list[str]) -> int:
    """The mask of some rules."""
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, and ``failed``: a long with bit b set where rule b fails.

    A null text counts as an empty one: all measurements 0. Words are maximal runs without ASCII white
    space; a text's windows are compared with one another by a 64-bit hash. Texts are read whole; one has
    to fit into a task. Repeated rows and null doc_ids stay rows of their own. Other columns are not
    read. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # each step's columns are used more than once by the next, so Catalyst keeps them as columns
    words = docs.select("doc_id", text.alias("t"), F.filter(F.split(text, GAP), lambda w: w != "").alias("w"))
    counted = words.select(
        "doc_id",
        "t",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.array_join("w", "").alias("joined"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.when(
            F.size("w") >= 3,
            F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.col("w")[i + 1], F.col("w")[i + 2])),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
    )
    measured = counted.select(
        "doc_id",
        "n_words",
        F.length("joined").cast("long").alias("word_chars"),
        F.regexp_count("joined", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.regexp_count("joined", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("joined", F.lit(r"\p{L}")).cast("long").alias("n_letters"),
        F.regexp_count("joined", F.lit("!!")).cast("long").alias("n_shouts"),
        # most texts have no window twice; the others sort their windows
        F.when(
            F.size(F.array_distinct("grams")) < F.size("grams"),
            F.array_sort(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ).alias("placed"),
    )
    again = F.filter(
        F.transform(
            "placed",
            lambda x, k: F.when(
                (x["g"] == F.get(F.col("placed"), k - 1)["g"]) | (x["g"] == F.get(F.col("placed"), k + 1)["g"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    repeated = measured.select(
        *[c for c in measured.columns if c != "placed"], F.when(F.col("placed").isNotNull(), F.array_sort(again)).alias("at")
    )
    # every window covers three words, less what the next one covers too
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")),
        lambda a: a["n"],
    )
    ready = repeated.select(*[c for c in repeated.columns if c != "at"], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = F.lit(0).cast("long")
    for b, condition in enumerate(RULES.values()):
        failed = failed + F.when(F.expr(condition), F.lit(1 << b)).otherwise(F.lit(0)).cast("long")
    return ready.withColumn("failed", failed)


def apply_policy(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """The ledger with ``kept``: whether none of the policy's rules failed."""
    return rows.withColumn("kept", F.col("failed").bitwiseAND(F.lit(bits(POLICIES[version])).cast("long")) == 0)


def ablations(rows: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rule, failed (documents it fails), alone (that only it fails), kept_without.

    Documents are first counted by their failure bits, of which there are at most 2 ** rules sets.
    """
    mask = bits(POLICIES[version])
    sets = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    order = list(RULES)
    own = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << order.index(r)).cast("long").alias("bit")) for r in POLICIES[version]])
    each = sets.select("f", "n", F.inline(own))
    hit = F.col("f").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("f") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone"),
        F.sum(F.when((F.col("f") == 0) | (F.col("f") == F.col("bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, the base measurements, base_failed, kept, and after them the whole ledger."""
    base = F.lit(bits(POLICIES["base"])).cast("long")
    rows = apply_policy(ledger(docs)).withColumn("base_failed", F.col("failed").bitwiseAND(base) != 0)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*first, "n_lines", "n_capitals", "n_letters", "n_shouts", "failed")
