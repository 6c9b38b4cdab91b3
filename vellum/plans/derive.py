"""Inputs derived from the benchmark tables by integer arithmetic, so that any SQL engine derives the same.

The benchmark tables hold no forms. Form fields come from ``lineitem``, OCR words and lines from
``documents``, questions from ``conversations`` and experiment runs from ``events``. A session has a
bounded number of rows whatever the scale. FIELDS and RUNS are SQL that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD_KEYS = ("First Name", "Last Name", "Loan Amount", "Tenor (months)", "Floating Rate", "ECS", "Gross Monthly Income", "Date:", "Branch", "PAN Card", "Male", "Yes")
FIELD_VALUES = ("", " 110 000", "36MONTHS", "15/02/200", "7,50,000", "15 000.", "Asha Rao", "42")


def _case(of: str, values: tuple[str, ...]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


FIELDS = f"""
SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS BIGINT) AS ord,
  {_case('CAST(l_partkey % 12 AS INT)', FIELD_KEYS)} AS key,
  {_case('CAST(l_suppkey % 8 AS INT)', FIELD_VALUES)} AS value,
  CAST(1 + l_linenumber % 3 AS INT) AS page,
  CAST(50 + (l_partkey * 37 % 5000) / CAST(100 AS DOUBLE) AS DOUBLE) AS value_confidence
FROM (SELECT *, 's' || CAST(CAST(floor(l_orderkey / 8) AS BIGINT) AS STRING) AS session_id FROM {{lineitem}}) l
"""

RUNS = """
SELECT event_id AS run_id, 'e' || CAST(user_id AS STRING) AS session_id, user_id, event_type AS intent, value AS latency,
  (event_id * 7919 % 1000) / CAST(1000 AS DOUBLE) AS faithfulness, (event_id * 104729 % 1000) / CAST(1000 AS DOUBLE) AS relevance,
  CAST(event_id * 31 % 900 + 100 AS BIGINT) AS tokens
FROM {events}
"""


#: A job for each user, a batch for each event, fetched in order of time: tokens name the next batch, names tell nothing. Some batches are missing, some were saved twice.
BATCHES = """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS follower FROM {events} e
), s AS (SELECT user_id, event_id, 'j' || CAST(user_id AS STRING) AS job_id, md5(CAST(event_id AS STRING)) AS batch,
  CASE WHEN no > 1 THEN md5(CAST(user_id AS STRING) || ':' || CAST(no AS STRING)) END AS request_token,
  CASE WHEN follower IS NOT NULL THEN md5(CAST(user_id AS STRING) || ':' || CAST(no + 1 AS STRING)) END AS next_token FROM n)
SELECT job_id, batch, request_token, next_token FROM s WHERE NOT (user_id % 3 = 1 AND event_id % 97 = 5)
UNION ALL SELECT job_id, batch || 'r', request_token, next_token FROM s WHERE event_id % 251 = 3
"""

#: Poll responses: a user's events of a day are a job's, asked for every few seconds or minutes from that day's start on. The
#: first or second poll succeeds or fails, further rows are batches by token; some rows are missing.
RESPONSES = """
WITH d AS (SELECT *, CAST(substr(CAST(ts AS STRING), 6, 2) AS BIGINT) * 31 + CAST(substr(CAST(ts AS STRING), 9, 2) AS BIGINT) AS day FROM {events} e
), o AS (SELECT *, 'j' || CAST(user_id AS STRING) || '-' || CAST(day AS STRING) AS job_id, row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS no,
  count(*) OVER (PARTITION BY user_id, day) AS n, 1 + user_id % 2 AS success FROM d
)
SELECT job_id, CAST(event_id AS STRING) AS batch, CAST(day * 86400 + user_id % 1000 + (no - 1) * (CASE WHEN user_id % 5 = 4 THEN 400 ELSE 5 END) AS BIGINT) AS asked_s,
  CASE WHEN no < success THEN 'IN_PROGRESS' WHEN no = success AND user_id % 11 = 3 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
  CASE WHEN no > success THEN 't' || CAST(no AS STRING) END AS request_token, CASE WHEN no >= success AND no < n THEN 't' || CAST(no + 1 AS STRING) END AS next_token
FROM o WHERE event_id % 23 <> 7
"""


#: Changes of status: a session is five days of a user; events stand for statuses, in no sensible order.
CHANGES = """
SELECT 'u' || CAST(user_id AS STRING) || '-' || CAST(day - day % 5 AS STRING) AS session_id,
  CASE event_type WHEN 'purchase' THEN 'READY' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PROCESSING' WHEN 'click' THEN 'UPLOADING' ELSE 'PROCESSING' END AS status, ts, event_id
FROM (SELECT *, CAST(substr(CAST(ts AS STRING), 6, 2) AS BIGINT) * 31 + CAST(substr(CAST(ts AS STRING), 9, 2) AS BIGINT) AS day FROM {events}) e
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FIELDS, lineitem=_table(spark, sf_dir, "lineitem"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RUNS, events=_table(spark, sf_dir, "events"))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BATCHES, events=_table(spark, sf_dir, "events"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RESPONSES, events=_table(spark, sf_dir, "events"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CHANGES, events=_table(spark, sf_dir, "events"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LINE and WORD blocks of ``documents``: three lines a page; every text line also yields its words."""
    docs = _table(spark, sf_dir, "documents")
    session = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("session_id")
    line = docs.select(session, "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line").cast("long"))
    page = (F.col("line") / 3).cast("int") + 1
    none = F.lit(None).cast("string")
    lines = line.select("session_id", (F.col("line") * 100000).alias("ord"), F.lit("LINE").alias("block_type"), page.alias("page"), "text", none.alias("text_type"), F.lit(None).cast("double").alias("confidence"))
    word = line.select("session_id", "doc_id", "line", page.alias("page"), F.posexplode(F.split("text", " ", -1)).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))
    mark = F.col("doc_id") * 7919 + F.col("line") * 104729 + F.col("pos") * 1299709 + F.length("text") * 31
    words = word.select(
        "session_id",
        (F.col("line") * 100000 + F.col("pos") + 1).alias("ord"),
        F.when(mark % 211 == 0, F.lit(None)).otherwise(F.lit("WORD")).alias("block_type"),
        "page",
        "text",
        F.when(mark % 97 == 0, "HANDWRITING").otherwise("PRINTED").alias("text_type"),
        (F.lit(40) + (mark % 6000) / F.lit(100.0)).alias("confidence"),
    )
    return lines.unionByName(words)


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block graph of ``fields``: a KEY block, two VALUE blocks of which the second wins, their words, one dangling id.

    Each row holds the blocks and edges of a field, so that nothing has to be dealt out after they became many.
    """
    o = F.col("ord").cast("string")

    def block(kind: str, prefix: str, at: int, text, confidence, entities: tuple[str, ...] = ()):
        return F.struct(
            (F.col("ord") * 10 + at).alias("ord"), F.concat(F.lit(prefix), o).alias("id"), F.lit(kind).alias("block_type"), F.col("page"),
            text.alias("text"), confidence.alias("confidence"), F.array(*map(F.lit, entities)).cast("array<string>").alias("entity_types"),
        )

    blank, sure = F.lit(""), F.lit(99.0)
    blocks_ = F.array(
        block("KEY_VALUE_SET", "k", 0, blank, F.lit(90.005), ("KEY",)),
        block("KEY_VALUE_SET", "u", 1, blank, F.lit(11.0), ("VALUE",)),
        block("KEY_VALUE_SET", "v", 2, blank, F.col("value_confidence"), ("VALUE",)),
        block("WORD", "kw", 3, F.col("key"), sure),
        block("WORD", "uw", 4, F.lit("old"), sure),
        block("WORD", "vw", 5, F.col("value"), sure),
        block("WORD", "vx", 6, F.lit("INR"), sure),
    )

    def edge(src: str, kind: str, rpos: int, ipos: int, dst: str):
        return F.struct(F.concat(F.lit(src), o).alias("src"), F.lit(kind).alias("rtype"), F.lit(rpos).alias("rpos"), F.lit(ipos).alias("ipos"), F.concat(F.lit(dst), o).alias("dst"))

    edges_ = F.array(
        edge("k", "CHILD", 0, 0, "kw"), edge("k", "VALUE", 1, 0, "u"), edge("k", "VALUE", 1, 1, "v"), edge("k", "VALUE", 1, 2, "gone"),
        edge("u", "CHILD", 0, 0, "uw"), edge("v", "CHILD", 0, 1, "vx"), edge("v", "CHILD", 0, 0, "vw"),
    )

    return fields(spark, sf_dir).select("session_id", blocks_.alias("blocks"), edges_.alias("edges"))


#: Which sessions have a table, and which have pages.
HAS_TABLE = "CAST(substr(session_id, 2) AS BIGINT) % 2 = 0"
HAS_PAGES = "CAST(substr(session_id, 2) AS BIGINT) % 7 <> 3"


def table_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block graph of tables, a row per field: for every other session a TABLE whose CELLs hold two WORDs each, and one without cells.

    Cells are placed by the field's order, with holes and doubles; a cell also refers to a missing word.
    """
    none = F.lit(None).cast("int")

    def block(at: int, id_, kind: str, text, confidence, row=none, col=none):
        return F.struct(
            (F.col("ord") * 10 + at).alias("ord"), id_.alias("id"), F.lit(kind).alias("block_type"), F.lit(1).alias("page"), text.alias("text"),
            confidence.alias("confidence"), row.alias("row_index"), col.alias("col_index"),
        )

    blank, sure = F.lit(""), F.lit(99.0)
    o, first = F.col("ord").cast("string"), F.col("ord") == 1
    row, col = (F.col("ord") % 5).cast("int"), ((F.col("ord") * 7) % 4).cast("int")
    blocks_ = F.array_compact(
        F.array(
            F.when(first, block(-2, F.lit("t1"), "TABLE", blank, sure)),
            F.when(first, block(-1, F.lit("t2"), "TABLE", blank, sure)),
            block(0, F.concat(F.lit("c"), o), "CELL", blank, F.col("value_confidence"), row, col),
            block(1, F.concat(F.lit("a"), o), "WORD", F.col("key"), sure),
            block(2, F.concat(F.lit("b"), o), "WORD", F.col("value"), sure),
        )
    )

    def edge(src, rpos, ipos, dst):
        return F.struct(src.alias("src"), F.lit("CHILD").alias("rtype"), rpos.alias("rpos"), ipos.alias("ipos"), dst.alias("dst"))

    zero = F.lit(0)
    cell = F.concat(F.lit("c"), o)
    edges_ = F.array(
        edge(F.lit("t1"), zero, F.col("ord").cast("int"), cell),
        edge(cell, zero, F.lit(1), F.concat(F.lit("b"), o)),
        edge(cell, zero, zero, F.concat(F.lit("a"), o)),
        edge(cell, F.lit(1), zero, F.lit("gone")),
    )

    return fields(spark, sf_dir).where(HAS_TABLE).select("session_id", blocks_.alias("blocks"), edges_.alias("edges"))


def cell(text: str) -> list[Column]:
    """A field as a cell of its session's table, placed by its order, with holes and doubles."""
    row, col = (F.col("ord") % 5).cast("int"), ((F.col("ord") * 7) % 4).cast("int")
    return [F.lit(1).alias("table_ord"), F.lit(1).alias("page"), row.alias("row"), col.alias("col"), F.col("ord").alias("pos"), F.col(text).alias("text")]


def cells(fields: DataFrame) -> DataFrame:
    """Table cells of ``fields``: a table for every other session."""
    return fields.where(HAS_TABLE).select("session_id", *cell("value"), F.col("value_confidence").alias("confidence"))


def artefacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` with what scanned text has: page markers, noise lines, cut words, typographic marks, blanks."""
    docs = _table(spark, sf_dir, "documents")
    before = "=== PAGE 1 ===\nShinhan Bank\nS\n  india  \nExtend Your Financial Network today\nmort-\ngage  \t terms\n\n\n\n“Rate” – it’s 5%\n"
    after = "\n=== PAGE 22 ===\nloan | rate | term\na\tb\tc\nend"
    return docs.select("doc_id", F.concat(F.lit(before), F.col("text"), F.lit(after)).alias("text"))


#: ``documents`` with abbreviations, initials and ordinals among their words.
SHORT_FORMS = (("and", "approx."), ("of", "e.g."), ("und", "bzw."), ("der", "Dr."), ("de", "Mr."), ("in", "J."), ("die", "3."))


def short_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for word, form in SHORT_FORMS:
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {form} "))
    return _table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


#: A table of aligned columns whose widths and rows vary, one by bars with a rule, and lines that are none.
TABLES = """
SELECT doc_id, text || chr(10) || rpad('Principal', CAST(12 + doc_id % 5 AS INT), ' ') || rpad('Rate', CAST(8 + doc_id % 3 AS INT), ' ') || 'Term of it'
  || chr(10) || rpad('$' || CAST(doc_id * 10 AS STRING), CAST(12 + doc_id % 5 AS INT), ' ') || rpad('4.' || CAST(doc_id % 7 AS STRING) || '%', CAST(8 + doc_id % 3 AS INT), ' ') || CAST(doc_id % 30 AS STRING) || ' years'
  || CASE WHEN doc_id % 2 = 0 THEN chr(10) || rpad('$7', CAST(12 + doc_id % 5 AS INT), ' ') || rpad('', CAST(8 + doc_id % 3 AS INT), ' ') || '1 year' ELSE '' END
  || chr(10) || 'no table' || chr(10) || '| a | b | c |' || chr(10) || '|---|---|---|' || chr(10) || '| 1 | ' || CAST(doc_id AS STRING) || ' | 3 |' || chr(10) || 'so' || chr(10) || 'x | y | z | w' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'end' ELSE chr(10) || 'p  q' END AS text
FROM {documents} d
"""


def tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TABLES, documents=_table(spark, sf_dir, "documents"))


QUESTION_STARTS = ("Summarize ", "Please explain ", "What is the interest rate of ", "The difference of ", "Where is ", "OVERVIEW ")


def ask(turns: DataFrame) -> DataFrame:
    """conv_id, turn and question of turns of conversations, of a batch or a stream."""
    starts = F.element_at(F.array(*map(F.lit, QUESTION_STARTS)), (F.col("turn") % 6 + 1).cast("int"))
    return turns.select("conv_id", "turn", F.concat(starts, F.col("text")).alias("question"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(_table(spark, sf_dir, "conversations"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Chunks with vectors, in sessions of 64 as a document has a bounded number of chunks, and a query for each: its vector backwards."""
    rows = _table(spark, sf_dir, "embeddings").select(
        F.expr("'v' || CAST(vec_id div 64 AS STRING)").alias("session_id"), F.col("vec_id").alias("chunk_id"), "embedding"
    )
    queries = rows.select(F.col("chunk_id").alias("query_id"), "session_id", F.reverse("embedding").alias("query"))
    return rows, queries


def long_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``vectors`` in sessions of 512, of different lengths: from one to a sixteenth, by powers of two, which engines divide by alike."""
    own = _table(spark, sf_dir, "embeddings").select(F.expr("'w' || CAST(vec_id div 512 AS STRING)").alias("session_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    shrunk = F.transform("embedding", lambda x: x.cast("double") / F.pow(F.lit(2.0), (F.col("chunk_id") % 5).cast("double")))
    return own.withColumn("embedding", shrunk), own.select(F.col("chunk_id").alias("query_id"), "session_id", F.transform("embedding", lambda x: x.cast("double")).alias("query"))


#: Questions of sessions, ten minutes apart; every other one is asked again.
ASKED = """
SELECT 'c' || CAST(conv_id AS STRING) AS session_id, turn, CAST(86400 + turn * 600 + conv_id % 97 AS BIGINT) AS asked_s, 'Question ' || CAST(turn % 2 AS STRING) AS question FROM {conversations} c
"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ASKED, conversations=_table(spark, sf_dir, "conversations"))
