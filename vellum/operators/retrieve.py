"""Exact retrieval inside a session: scores, ranks, thresholds, context and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import serving as S

# ---- fixed values -----------------------------------------------------------------------------
NOT_FOUND = (
    "I could not find relevant information in this document to answer your question. "
    "Please verify the document contains the relevant section."
)
SYSTEM = (
    "You are a precise assistant that answers questions about loan documents.\n"
    "Answer ONLY based on the provided document excerpts.\n"
    "If the information is not in the excerpts, say so clearly.\n"
    "Do not use knowledge from outside the document.\n"
    "Be concise and direct."
)
EXCERPTS = "{system_instruction}\n\nDocument excerpts:\n{context}\n\nQuestion: {question}\n\n"
TEMPLATES = {
    ("finance", "A"): EXCERPTS
    + "Instructions:\n- Extract the exact numerical value(s) requested\n- Include units (%, $, years, months)\n"
    "- Quote the relevant clause\n- If not found, say \"Not specified in this document\"\n\nAnswer:",
    ("finance", "B"): "{system_instruction}\n\nBased on this document:\n{context}\n\n{question}\n\nAnswer with the specific number or value. Be brief.",
    ("summary", "A"): EXCERPTS
    + "Instructions:\n- Provide a structured summary with clear sections\n"
    "- Focus on: loan amount, interest rate, repayment terms, key obligations, important conditions\n"
    "- Use bullet points for readability\n- 200-300 words maximum\n\nAnswer:",
    ("explanation", "A"): EXCERPTS
    + "Instructions:\n- Explain in plain English as if the reader has no legal/financial background\n"
    "- Define any technical terms used\n- Reference where in the document this is described (e.g., \"According to Section 4\")\n\nAnswer:",
    ("retrieval", "A"): EXCERPTS + "Answer directly and concisely. If the answer is not in the document, state that clearly.\n\nAnswer:",
    ("comparison", "A"): EXCERPTS
    + "Instructions:\n- Present as a clear comparison\n- Use a table format if more than 2 items are compared\n- Highlight the key differences\n\nAnswer:",
}
TEMPLATE_VERSION = "v1"
# -----------------------------------------------------------------------------------------------


def _best(scored: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, run: int = 1024) -> DataFrame:
    """query_id, session_id, rank, chunk_id, score: the k best chunks of each query's own session.

    An equi join on the session, never a cross join, in two levels: a session's chunks and its queries
    are cut into runs of about ``run`` by the numbers that were counted, so a task's group is a run of
    queries against a run of chunks (some ``run`` squared scores) however large a session is. Each group
    keeps its k best for each query, and those are merged. Ties of scores go to the smaller chunk_id.
    Sessions of up to ``run`` chunks and queries are one group. Rows that lack a session take no part.
    """
    sizes = chunks.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("session_id").agg(F.count(F.lit(1)).alias("m")), "session_id")
    # sessions of more than one group: at most one for each ``run`` rows
    runs = lambda c: F.expr(f"({c} + {run - 1}) div {run}")
    large = sizes.where((F.col("n") > run) | (F.col("m") > run)).select("session_id", runs("n").alias("c_runs"), runs("m").alias("q_runs"))
    one = F.lit(1).cast("long")

    def dealt(rows: DataFrame, id_: str, own: str, other: str) -> DataFrame:
        """``rows`` in a run of their own, and once in every run of the other side."""
        told = rows.join(large, "session_id", "left")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"{other}_runs", one) - 1))
        return told.withColumn(f"{own}_run", F.pmod(F.xxhash64(id_), F.coalesce(f"{own}_runs", one))).withColumn(f"{other}_run", every).drop("c_runs", "q_runs")

    asked, there = dealt(queries, "query_id", "q", "c"), dealt(chunks, "chunk_id", "c", "q")
    keys = ["session_id", "q_run", "c_run"]
    scored = asked.join(there, keys).select("query_id", *keys, "chunk_id", S.dot(F.col("query"), F.col("embedding")).alias("score"))
    # the first cut is within the groups as the join has dealt them, so it needs no further shuffle
    first = _best(scored, [*keys, "query_id"], k, "_place").select("query_id", "session_id", "chunk_id", "score")
    return _best(first, ["query_id"], k, "rank")


def above(hits: DataFrame, least: float = 0.25) -> DataFrame:
    """Hits that score ``least`` or more; applied after the cut to k."""
    return hits.where(F.col("score") >= least)


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, chunks_used, answer, intent: queries without a hit get the fixed answer."""
    counts = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.col("n").isNull()
    return queries.join(counts, "query_id", "left").select(
        "query_id",
        F.coalesce("n", F.lit(0)).alias("chunks_used"),
        F.when(none, F.lit(NOT_FOUND)).alias("answer"),
        F.when(none, F.lit("unknown")).otherwise(F.lit("retrieval")).alias("intent"),
    )


def within_budget(hits: DataFrame, most_chars: int = 7000) -> DataFrame:
    """Hits in order of rank until the first that would pass ``most_chars`` characters of text."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("used_chars", F.sum(F.length("text")).over(upto)).where(F.col("used_chars") <= most_chars)


def context(hits: DataFrame, labelled: bool = True) -> DataFrame:
    """query_id, context, context_chars, chunks_included: the hits' texts in order of rank."""
    own = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]\n"), F.col("text")) if labelled else F.col("text")
    ordered = F.sort_array(F.collect_list(F.struct("rank", own.alias("t"))))
    return hits.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("context"),
        F.sum(F.length("text")).alias("context_chars"),
        F.count(F.lit(1)).alias("chunks_included"),
    )


def fill(intent, variant, context_, question):
    """The prompt of an intent and variant; an intent without a variant B uses its A."""
    out = None
    for (name, which), template in TEMPLATES.items():
        text = F.lit(template.replace("{system_instruction}", SYSTEM))
        # the question goes in last, so that nothing in it is taken for a placeholder
        filled = F.replace(F.replace(text, F.lit("{context}"), context_), F.lit("{question}"), question)
        own = (intent == name) & ((variant == which) if name == "finance" else F.lit(True))
        out = F.when(own, filled) if out is None else out.when(own, filled)
    return out


def trim(hits: DataFrame, base_tokens: str, most: int = 3000) -> DataFrame:
    """Hits in order of rank as long as their tokens and the prompt's own stay within ``most``."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("prompt_tokens", F.col(base_tokens) + F.sum("tokens").over(upto)).where(F.col("prompt_tokens") <= most)
