"""A saved vector index: blocks in order of length, and exact search that skips blocks by what they can reach at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import serving as S
from vellum.sources.workspace import settle

#: Vectors of a block.
BLOCK = 16


def _length(v: str):
    return F.sqrt(S.dot(F.col(v), F.col(v)))


def save(vectors: DataFrame, path: str, block: int = BLOCK) -> None:
    """Write ``vectors`` (session_id, chunk_id, embedding) to ``path`` as blocks, the longest vectors of a session first.

    A row is a block of a session: block_no, reach (its greatest length) and its vectors. Null vectors
    are left out. Ranks of length are told by session in one sorted pass.
    """
    own = vectors.where("embedding IS NOT NULL").select("session_id", "chunk_id", "embedding", _length("embedding").alias("length"))
    order = Window.partitionBy("session_id").orderBy(F.col("length").desc(), "chunk_id")
    numbered = own.withColumn("block_no", ((F.row_number().over(order) - 1) / block).cast("long"))
    blocks = numbered.groupBy("session_id", "block_no").agg(F.max("length").alias("reach"), F.collect_list(F.struct("chunk_id", "embedding")).alias("vectors"))
    blocks.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _scored(asked: DataFrame) -> DataFrame:
    """A row for each vector of the blocks that a query meets."""
    own = asked.select("query_id", "session_id", "query", "block_no", F.explode("vectors").alias("v"))
    return own.select("query_id", "session_id", "block_no", F.col("v.chunk_id").alias("chunk_id"), S.dot(F.col("query"), F.col("v.embedding")).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: DataFrame, k: int = 5, opening: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, skipped): the exact k best of each query in its session, and blocks and blocks_skipped for each query.

    hits: query_id, session_id, rank, chunk_id, score; ties go to the smaller chunk_id. No inner product
    passes the product of both lengths. So a query (query_id, session_id, query) first meets the blocks
    of the longest vectors that hold ``opening`` of them (8 k, if not given; k at least); the k-th score there is what a further block must be able
    to reach, and of others not even the vectors are multiplied. Blocks that reach exactly that score
    are met, as a smaller chunk_id may tie. Queries without vectors in their session have no rows.
    """
    opening = max(k, 8 * k if opening is None else opening)
    asked = queries.where("query IS NOT NULL").select("query_id", "session_id", "query", _length("query").alias("length"))
    upto = Window.partitionBy("session_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    told = index.withColumn("held", F.coalesce(F.sum(F.size("vectors")).over(upto), F.lit(0)))
    met = asked.join(told.where(F.col("held") < opening).drop("held"), "session_id")
    first = settle(_best(_scored(met), k), "index-first")
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    rest = told.where(F.col("held") >= opening).drop("held")
    # lengths are rounded: what a block can reach is taken a little wider
    reach = F.col("reach") * F.col("length") * (1 + 1e-9) + 1e-9
    more = asked.join(least, "query_id").join(rest, "session_id").where(F.col("least").isNull() | (reach >= F.col("least")))
    more = more.select("query_id", "session_id", "query", "block_no", "vectors")
    hits = _best(first.drop("rank").unionByName(_scored(more)), k).select("query_id", "session_id", "rank", "chunk_id", "score")
    sizes = index.groupBy("session_id").agg(F.count(F.lit(1)).alias("blocks"))
    opened = met.select("query_id").unionByName(more.select("query_id")).groupBy("query_id").agg(F.count(F.lit(1)).alias("opened"))
    skipped = asked.join(sizes, "session_id").join(opened, "query_id", "left").select("query_id", "blocks", (F.col("blocks") - F.coalesce("opened", F.lit(0))).alias("blocks_skipped"))
    return hits, skipped
