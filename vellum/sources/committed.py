"""Objects by key as a data source: whole listings, objects of no bytes included, and writes in two phases.

A write stages its objects beside the store. Only when all tasks are done is it marked as committed, and
its objects are moved to their keys, by tasks again; a write that fails is deleted before anything can be
seen. What a driver that is lost after the mark leaves behind is moved by ``publish``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vellum.sources.objects import _system

#: Names beside the store's own keys: a write's folder, and the mark in it.
STAGED, MARK = ".staged-", ".committed"
SCHEMA = "key string, length long, content binary"
NAMES = ["key", "length", "content"]


def _files(system, folder: str, recursive: bool) -> list:
    from pyarrow import fs

    return system.get_file_info(fs.FileSelector(folder, recursive=recursive, allow_not_found=True))


#: Objects and bytes of a batch of rows; folders that a task lists, at least, and the most tasks that a listing is cut into.
BATCH, BATCH_BYTES = 4096, 16 << 20
FOLDERS, MOST_TASKS = 256, 1024


@dataclass
class Folders(InputPartition):
    """Folders below the root (an empty name: the root itself), of which ``deep`` ones are listed with all that lies below them."""

    names: list[str]
    deep: bool


class ObjectReader(DataSourceReader):
    def __init__(self, root: str, prefix: str, contents: bool) -> None:
        self.root, self.prefix, self.contents = root, prefix.strip("/"), contents

    def _base(self):
        system, base = _system(self.root)
        return system, base.rstrip("/") + (f"/{self.prefix}" if self.prefix else "")

    def partitions(self) -> list[Folders]:
        """Runs of the folders two levels down, whose tasks list them by themselves, and one for the files above."""
        from pyarrow import fs

        system, base = self._base()
        above, level = [""], [""]
        for depth in range(2):
            below = []
            for name in level:
                for info in _files(system, f"{base}/{name}".rstrip("/"), False):
                    if info.type == fs.FileType.Directory and not info.base_name.startswith(STAGED):
                        below.append(f"{name}/{info.base_name}".lstrip("/"))
            if depth == 0:
                above += below
            level = below
        # a task for many folders, as a store may have one a session
        tasks = min(MOST_TASKS, -(-len(level) // FOLDERS))
        return [Folders(above, False), *(Folders(level[k::tasks], True) for k in range(tasks))]

    def _batch(self, keys: list[str], sizes: list[int], contents: list[bytes | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], names=NAMES)

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = self._base()
        keys, sizes, contents, held = [], [], [], 0
        for name in partition.names:
            for info in _files(system, f"{base}/{name}".rstrip("/"), partition.deep):
                if info.type != fs.FileType.File:
                    continue
                content = None
                if self.contents:
                    with system.open_input_stream(info.path) as f:
                        content = f.read()
                own = info.path[len(base) + 1 :]
                keys.append(f"{self.prefix}/{own}" if self.prefix else own)
                sizes.append(info.size)
                contents.append(content)
                held += len(content or b"")
                if len(keys) >= BATCH or held >= BATCH_BYTES:
                    yield self._batch(keys, sizes, contents)
                    keys, sizes, contents, held = [], [], [], 0
        if keys:
            yield self._batch(keys, sizes, contents)


class Written(WriterCommitMessage):
    pass


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, root: str) -> None:
        self.root, self.job = root, f"{STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _system(self.root)
        for batch in iterator:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content").to_pylist()):
                if not key or any(part in ("", ".", "..") or part.startswith(STAGED) for part in key.split("/")):
                    raise ValueError(f"{key!r} is no key")
                path = f"{base.rstrip('/')}/{self.job}/{key}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(content or b"")
        return Written()

    def commit(self, messages: list) -> None:
        system, base = _system(self.root)
        system.create_dir(f"{base.rstrip('/')}/{self.job}", recursive=True)
        with system.open_output_stream(f"{base.rstrip('/')}/{self.job}/{MARK}") as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        system, base = _system(self.root)
        from pyarrow import fs

        if system.get_file_info(f"{base.rstrip('/')}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{base.rstrip('/')}/{self.job}")


class ObjectSource(DataSource):
    """``spark.read.format("vellum_objects")`` with the options root, prefix and contents (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "vellum_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options["root"], self.options.get("prefix", ""), self.options.get("contents", "true") == "true")

    def writer(self, schema, overwrite: bool) -> ObjectWriter:
        return ObjectWriter(self.options["root"])


def _source(spark: SparkSession) -> None:
    spark.dataSource.register(ObjectSource)


def list_keys(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key and length of every object whose key lies in the folder ``prefix``, those of no bytes too; none: no rows."""
    _source(spark)
    return spark.read.format("vellum_objects").options(root=root, prefix=prefix, contents="false").load().select("key", "length")


def get(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """key, length and content of every object in the folder ``prefix``."""
    _source(spark)
    return spark.read.format("vellum_objects").options(root=root, prefix=prefix).load()


def publish(spark: SparkSession, root: str) -> int:
    """Move the objects of every committed write to their keys, and return how many writes that were.

    Moves are made in tasks, and one that is made again finds its object moved. Of several writes of a
    key the last published stands. Writes that are not committed are left alone.
    """
    from pyarrow import fs

    system, base = _system(root)
    base = base.rstrip("/")
    done = 0
    for info in sorted(_files(system, base, False), key=lambda i: (i.mtime is not None, i.mtime, i.path)):
        name = info.path.rsplit("/", 1)[-1]
        if not name.startswith(STAGED) or system.get_file_info(f"{info.path}/{MARK}").type != fs.FileType.File:
            continue
        staged = list_keys(spark, f"{root.rstrip('/')}/{name}").where(F.col("key") != MARK)

        def move(batches: Iterator[pa.RecordBatch], name: str = name) -> Iterator[pa.RecordBatch]:
            system, base = _system(root)
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    source, target = f"{base.rstrip('/')}/{name}/{key}", f"{base.rstrip('/')}/{key}"
                    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    if system.get_file_info(source).type == fs.FileType.File:
                        system.move(source, target)
                yield batch.select(["key"])

        staged.select("key").mapInArrow(move, "key string").write.format("noop").mode("overwrite").save()
        system.delete_dir(info.path)
        done += 1
    return done


def put(rows: DataFrame, root: str) -> None:
    """Write ``content`` (string or binary; null: no bytes) of every row to the object ``key``: all of them, or none if it fails."""
    spark = rows.sparkSession
    _source(spark)
    content = F.coalesce(F.col("content").cast("binary"), F.lit(b""))
    own = rows.select("key", F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    # a small table lies in one split, but each row is a file to make: all cores take part
    own.repartition(spark.sparkContext.defaultParallelism, "key").write.format("vellum_objects").option("root", root).mode("append").save()
    publish(spark, root)
