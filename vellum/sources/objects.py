"""Objects by key: put, get and delete in tasks, and embedding matrices as objects.

A root is a URI of any file system that pyarrow knows, shared by all machines. Objects are written one
per row by the task that holds the row; a task that runs again writes the same bytes again.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.sources import ocr


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def put(rows: DataFrame, root: str) -> DataFrame:
    """Write ``content`` (string or binary) of every row to the object ``key`` below ``root``: key, bytes written.

    The objects are there once the result has been read or written. A null content is an empty object.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _system(root)
        for batch in batches:
            sizes = []
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{base.rstrip('/')}/{key}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["key", "bytes"])

    return rows.select("key", F.col("content").cast("binary").alias("content")).mapInArrow(run, "key string, bytes long")


def delete(keys: DataFrame, root: str) -> DataFrame:
    """Delete the object ``key`` of every row: key, deleted (false where there was none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = _system(root)
        for batch in batches:
            paths = [f"{base.rstrip('/')}/{key}" for key in batch.column(0).to_pylist()]
            there = [info.type == fs.FileType.File for info in system.get_file_info(paths)] if paths else []
            for path, own in zip(paths, there):
                if own:
                    system.delete_file(path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(there, pa.bool_())], names=["key", "deleted"])

    return keys.select("key").mapInArrow(run, "key string, deleted boolean")


def get(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length and content (binary) of the objects below ``root``; contents are read only where they are used.

    Spark's file sources pass over objects of no bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "content")


def get_text(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and text (UTF-8) of the objects below ``root``."""
    return get(spark, root, pattern).select("path", F.decode("content", "UTF-8").alias("text"))


def save_vectors(vectors: DataFrame, root: str) -> DataFrame:
    """Write each session's vectors (session_id, chunk_id, embedding) as one matrix in order of the chunks: key, bytes.

    Vectors of a session are of one length and, as a document's chunks, few enough for one task.
    """

    def matrix(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_id")
        out = io.BytesIO()
        np.save(out, np.array(table.column("embedding").to_pylist(), np.float32))
        return pa.table({"session_id": table.column("session_id")[:1], "content": pa.array([out.getvalue()], pa.binary())})

    matrices = vectors.select("session_id", "chunk_id", "embedding").groupBy("session_id").applyInArrow(matrix, "session_id string, content binary")
    return put(matrices.select(ocr.key("embeddings", F.col("session_id")).alias("key"), "content"), root)


def load_vectors(spark: SparkSession, root: str) -> DataFrame:
    """session_id, row (from 0, in order of the chunks) and embedding of all saved matrices below ``root``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for session, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.load(io.BytesIO(content))
                columns = [pa.array([session] * len(found)), pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.tolist(), pa.list_(pa.float32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["session_id", "row", "embedding"])

    name = ocr.KEYS["embeddings"].rsplit("/", 1)[1]
    found = get(spark, root, name).select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("session_id"), "content")
    return found.mapInArrow(rows, "session_id string, row int, embedding array<float>")
