"""A folder that driver and executors share, and what is written there for later steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a landed table: about so many bytes of input each, and never more than the bound, as each is a file and a task.
BUCKET_BYTES, MOST_BUCKETS = 128 << 20, 65_536


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only where that is unset on one machine, as in
    tests, is a temporary folder made and set for the session; elsewhere that is an error, as other
    machines would not see the folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("vellum.shared.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("vellum.shared.dir", folder)
    return folder.rstrip("/")


#: What this process has written to the shared folder and not deleted, and the application that did.
_written: list[str] = []
_owner: dict[str, str] = {}


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted by ``release``."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    _owner[path] = spark.sparkContext.applicationId
    return path


def delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _forget(spark: SparkSession, paths: list[str]) -> None:
    for name in paths:
        delete(spark, name)
        _written.remove(name)
        del _owner[name]


def release(spark: SparkSession) -> None:
    """Delete all that has been written for this application and is still kept; results that read it end with it."""
    _forget(spark, [p for p in _written if _owner[p] == spark.sparkContext.applicationId])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is written inside is deleted at the end: for results that have been written elsewhere by then."""
    before = set(_written)
    try:
        yield
    finally:
        _forget(spark, [p for p in _written if p not in before and _owner[p] == spark.sparkContext.applicationId])


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: an executor lost later costs a reread of files, not a rerun of the steps
    before. A written table, unlike a cached one, also outlives the executor that made it.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What ``make`` returns, written and read back; all that it wrote on the way is deleted."""
    path = shared_path(spark, tag)
    with scratch(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _size(df: DataFrame) -> int:
    """Bytes that the optimizer expects of ``df``, from the sizes of the files that it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def landed(rows: DataFrame, key: str, tag: str) -> DataFrame:
    """``rows`` written once in buckets by ``key`` and read back: steps that group or join by it need no shuffle.

    The number of buckets follows the size that the optimizer expects, one for BUCKET_BYTES and never
    fewer than the cores, so a bucket, which is read by one task, stays small at any size. The
    table's entry in the catalog goes as soon as it has been read; its files stay until ``release``.
    """
    spark = rows.sparkSession
    name, path = f"{tag.replace('-', '_')}_{uuid.uuid4().hex}", shared_path(spark, tag)
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-_size(rows) // BUCKET_BYTES)))
    rows.repartition(buckets, F.col(key)).write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written
