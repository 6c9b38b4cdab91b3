"""OCR responses and objects: readers, writers and the layout of their keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources.workspace import settle

BLOCK = (
    "struct<Id:string,BlockType:string,Page:int,Text:string,TextType:string,Confidence:double,RowIndex:int,ColumnIndex:int,"
    "EntityTypes:array<string>,Relationships:array<struct<Type:string,Ids:array<string>>>>"
)
#: RequestToken, the token that a batch was asked for with, is not in what the service sends; who lands a response adds it.
RESPONSE = f"JobId string, JobStatus string, RequestToken string, NextToken string, Blocks array<{BLOCK}>"
#: Where a session's artefacts lie.
KEYS = {
    "upload_pdf": "uploads/{}/original.pdf",
    "raw_text": "extracted/{}/raw_text.txt",
    "cleaned_text": "extracted/{}/cleaned_text.txt",
    "validation_report": "extracted/{}/validation_report.json",
    "ocr_response": "extracted/{}/textract_response.json",
    "chunks": "chunks/{}/chunks.json",
    "embeddings": "chunks/{}/embeddings.npy",
    "vector_index": "chunks/{}/faiss.index",
}


def key(kind: str, session: Column) -> Column:
    before, after = KEYS[kind].split("{}")
    return F.concat(F.lit(before), session, F.lit(after))


def uri(bucket: str, key_: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), key_)


def route(page_count: Column, threshold: int = 2) -> Column:
    return F.when(page_count < threshold, "sync").otherwise("async")


def session_of(path: Column) -> Column:
    """A session's id from its file's name, without every ``_raw``."""
    return F.replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_raw"), F.lit(""))


def responses_of(rows: DataFrame) -> DataFrame:
    """One row per saved response: session_id, job_id, status, batch (the file's name), its tokens and blocks."""
    name = F.col("_metadata.file_name")
    return rows.select(
        session_of(name).alias("session_id"), name.alias("batch"), F.col("JobId").alias("job_id"), F.col("JobStatus").alias("status"),
        F.col("RequestToken").alias("request_token"), F.col("NextToken").alias("next_token"), "Blocks",
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    return responses_of(spark.read.schema(RESPONSE).option("multiLine", True).json(path))


def batch_order(batches: DataFrame) -> DataFrame:
    """job_id, batch, batch_no and job_state of every batch: its place in its job's chain of tokens.

    ``batches`` has job_id, batch (unique in its job), request_token (null for the first batch) and
    next_token (null for the last). A batch follows the one whose next_token it was asked for with.
    Places are found by pointer doubling: in round k every batch knows the batch 2^k before it and how
    many lie between, so a chain of n batches takes log2(n) rounds, each a join on unique keys.

    job_state: ``whole`` if the chain runs from a first batch to a last one; ``open`` if its end has a
    next_token that no batch has been asked for with; ``gap`` if batches stand behind a missing one;
    ``cycle`` if tokens lead back to themselves. Batches that no first batch leads to have a null
    batch_no. Of several batches asked for with one token (or none), the first by name counts, the
    others are ``repeat``s of a null batch_no and don't affect their job.

    Jobs of which no batch but one kind is known, as nothing was landed with tokens (several batches, all
    without a request_token), are ordered by name, numbers in names by value, and are ``named``.
    """
    keys = ["job_id", "batch"]
    own = batches.select(*keys, F.col("request_token").alias("asked"), F.col("next_token").alias("next"))
    jobs = own.groupBy("job_id").agg((F.count("asked") == 0).alias("bare"), F.count(F.lit(1)).alias("n"))
    # hot jobs: the joins below are by job and token; this one has a row a job, so its large side may be split
    own = own.join(jobs.select("job_id", ((F.col("n") > 1) & F.col("bare")).alias("named")), "job_id")
    kept = own.where("NOT named").groupBy("job_id", "asked").agg(F.min("batch").alias("batch"), F.min_by("next", "batch").alias("next"))
    # batches by number from here on: rounds move a few longs a batch, no names or tokens
    kept = settle(kept.withColumn("id", F.monotonically_increasing_id()), "batch-links")
    before = kept.where("next IS NOT NULL").groupBy("job_id", F.col("next").alias("asked")).agg(F.min_by("id", "batch").alias("up"))
    state = kept.select("job_id", "asked", "id").join(before, ["job_id", "asked"], "left").select(
        "id", "up", F.col("up").isNotNull().cast("long").alias("place"), (F.col("asked").isNotNull() & F.col("up").isNull()).alias("lost")
    )
    state = settle(state, "batch-places")
    length, reach = kept.count(), 1
    while reach <= length and not state.where("up IS NOT NULL").isEmpty():
        above = state.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("place").alias("more"), F.col("lost").alias("lost_above"))
        moved = state.where("up IS NOT NULL").join(above, "up").select(
            "id", F.col("far").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("lost") | F.col("lost_above")).alias("lost")
        )
        state = settle(state.where("up IS NULL").unionByName(moved), "batch-places")
        reach *= 2
    # whoever still has a batch before it after so many rounds stands in a cycle or behind one
    told = kept.join(state, "id").withColumn("cycle", F.col("up").isNotNull())
    followed = kept.select("job_id", F.col("asked").alias("next"), F.lit(True).alias("followed")).where("next IS NOT NULL")
    told = told.join(followed, ["job_id", "next"], "left")
    ranked = ~F.col("cycle") & ~F.col("lost")
    states = told.groupBy("job_id").agg(
        F.when(F.bool_or("cycle"), "cycle").when(F.bool_or("lost") | ~F.bool_or(F.col("asked").isNull()), "gap")
        .when(F.bool_or(F.col("next").isNotNull() & F.col("followed").isNull()), "open").otherwise("whole").alias("job_state")
    )
    placed = told.select(*keys, F.when(ranked, F.col("place")).alias("batch_no"), F.lit(True).alias("counts"))
    chained = own.where("NOT named").select(*keys).join(placed, keys, "left").join(states, "job_id")
    chained = chained.select(*keys, "batch_no", F.when(F.col("counts"), F.col("job_state")).otherwise("repeat").alias("job_state"))
    # names in their natural order: each number padded to one width
    natural = F.regexp_replace(F.regexp_replace("batch", r"(\d+)", "0000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")
    by_name = Window.partitionBy("job_id").orderBy(natural, "batch")
    named = own.where("named").select(*keys, (F.row_number().over(by_name) - 1).cast("long").alias("batch_no"), F.lit("named").alias("job_state"))
    return chained.unionByName(named)


def join_batches(responses: DataFrame) -> DataFrame:
    """Responses whose batches of one job belong to one session, that of the job's first batch, with their batch_no.

    Batches follow their tokens (see ``batch_order``). Responses without a job stay as they are; jobs
    with a failed batch go, and so do those whose chain isn't whole, repeated batches included.
    """
    jobs = responses.where("job_id IS NOT NULL")
    order = settle(batch_order(jobs), "batch-order").where("job_state IN ('whole', 'named')")
    placed = jobs.join(order.select("job_id", "batch", "batch_no"), ["job_id", "batch"])
    told = placed.groupBy("job_id").agg(
        F.min_by("session_id", "batch_no").alias("_first"), F.bool_or(F.coalesce("status", F.lit("")) == "FAILED").alias("_failed")
    )
    joined = placed.join(told.where("NOT _failed"), "job_id").withColumn("session_id", F.col("_first"))
    alone = responses.where("job_id IS NULL AND NOT coalesce(status = 'FAILED', false)").withColumn("batch_no", F.lit(0).cast("long"))
    return joined.select(*responses.columns, "batch_no").unionByName(alone)


def blocks(responses: DataFrame) -> DataFrame:
    """One row per block; ``ord`` keeps the order of batches (by batch_no where there is one, else by name) and of blocks in them."""
    number = F.col("batch_no") if "batch_no" in responses.columns else F.lit(0).cast("long")
    own = responses.select("session_id", number.alias("batch_no"), "batch", F.posexplode("Blocks").alias("pos", "b"))
    return own.select(
        "session_id",
        F.struct("batch_no", "batch", "pos").alias("ord"),
        F.col("b.Id").alias("id"),
        F.col("b.BlockType").alias("block_type"),
        F.coalesce("b.Page", F.lit(1)).alias("page"),
        F.coalesce("b.Text", F.lit("")).alias("text"),
        F.col("b.TextType").alias("text_type"),
        F.coalesce("b.Confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("b.RowIndex", F.lit(0)).alias("row_index"),
        F.coalesce("b.ColumnIndex", F.lit(0)).alias("col_index"),
        F.coalesce("b.EntityTypes", F.array().cast("array<string>")).alias("entity_types"),
        F.col("b.Relationships").alias("relationships"),
    )


def missing_sessions(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """Sessions asked for that no listed object belongs to."""
    return wanted.join(there, "session_id", "left_anti")


def list_objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length: objects below a root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def write_by_session(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Rows in a folder per session, so that later reads of one session prune the rest."""
    rows.write.mode("overwrite").partitionBy("session_id").format(kind).save(path)


def records(rows: DataFrame) -> DataFrame:
    """Every row as one JSON string."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
