"""Sharding by Karmarkar-Karp differencing: indivisible groups, shards of near equal bytes.

Documents of equal text form one group and share a shard. Groups are dealt by hash into buckets of
bounded size; each bucket is differenced in a task of its own into one partial partition of
``n_shards`` bins. The partial partitions are then differenced with one another, ``fan_in`` at a
time, level by level, until one is left. No task holds more than about ``bucket_rows`` groups or
``fan_in`` partial partitions, whatever the size of the corpus.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import join_hot, parts, settle


def difference(states: list[list[int]]) -> list[list[int]]:
    """Combine partial partitions by Karmarkar-Karp differencing.

    Each state is a list of bin sums, all of one length k. The two states of largest spread are
    combined again and again, largest bin with smallest, until one is left. Returns for each state
    the final bin of each of its bins. Final bins are numbered from the largest sum to the smallest.
    """
    if not states:
        return []
    k = len(states[0])
    nodes: list[tuple] = []  # ("leaf", order) or ("pair", left, right, order)
    heap = []
    for sums in states:
        order = sorted(range(k), key=lambda i: -sums[i])
        nodes.append((None, None, order))
        ranked = [sums[i] for i in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    while len(heap) > 1:
        _, left, a = heapq.heappop(heap)
        _, right, b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(k), key=lambda i: -sums[i])
        nodes.append((left, right, order))
        ranked = [sums[i] for i in order]
        heapq.heappush(heap, (ranked[-1] - ranked[0], len(nodes) - 1, ranked))
    labels: list[list[int] | None] = [None] * len(nodes)
    labels[-1] = list(range(k))
    for at in range(len(nodes) - 1, -1, -1):
        left, right, order = nodes[at]
        mine = labels[at]
        own = [0] * k
        for rank, i in enumerate(order):
            own[i] = mine[rank]
        if left is None:
            labels[at] = own
        else:
            labels[left] = own
            labels[right] = own[::-1]
            labels[at] = None
    return labels[: len(states)]


def _leaf(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "key"], ascending=[False, True], kind="stable")
        rest = [0] * (n_shards - 1)
        placed = difference([[int(b), *rest] for b in pdf["bytes"]])
        return pdf.assign(bin=[p[0] for p in placed])

    return run


def _level(n_shards: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sums: dict[int, list[int]] = {}
        for bucket, b, total in zip(pdf["bucket"], pdf["bin"], pdf["bytes"]):
            sums.setdefault(int(bucket), [0] * n_shards)[int(b)] = int(total)
        buckets = sorted(sums)
        placed = difference([sums[x] for x in buckets])
        rows = [(x, b, int(pdf["parent"].iloc[0]), p[b]) for x, p in zip(buckets, placed) for b in range(n_shards)]
        return pd.DataFrame(rows, columns=["bucket", "bin", "parent", "parent_bin"])

    return run


def assign_groups(groups: DataFrame, n_shards: int, bucket_rows: int = 20_000, fan_in: int = 256) -> DataFrame:
    """``groups`` (key binary, bytes long) with the ``shard`` of each; see the module's text."""
    spark = groups.sparkSession
    buckets = parts(spark, groups.count(), bucket_rows)
    dealt = groups.select("key", "bytes", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
    placed = settle(
        dealt.groupBy("bucket").applyInPandas(_leaf(n_shards), "key binary, bytes long, bucket long, bin int"), "kk-leaf"
    )
    place = placed.select("key", "bucket", "bin")
    sums = placed.groupBy("bucket", "bin").agg(F.sum("bytes").alias("bytes"))
    while buckets > 1:
        with_parent = sums.withColumn("parent", F.expr(f"bucket div {fan_in}"))
        moves = settle(
            with_parent.groupBy("parent").applyInPandas(_level(n_shards), "bucket long, bin int, parent long, parent_bin int"),
            "kk-level",
        )
        step = moves.select("bucket", "bin", "parent", "parent_bin")
        place = place.join(step, ["bucket", "bin"]).select("key", F.col("parent").alias("bucket"), F.col("parent_bin").alias("bin"))
        sums = (
            sums.join(step, ["bucket", "bin"])
            .groupBy(F.col("parent").alias("bucket"), F.col("parent_bin").alias("bin"))
            .agg(F.sum("bytes").alias("bytes"))
        )
        buckets = parts(spark, buckets, fan_in)
    return place.select("key", F.col("bin").cast("int").alias("shard"))


def shard_documents(docs: DataFrame, n_shards: int = 24, slot_rows: int = 25_000) -> DataFrame:
    """Put every document into one of ``n_shards`` shards of near equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text plus 8), text_crc32, law (always ``bytes``),
    shard, slot (gapless from 0 within the shard) and grown_shard (null: bytes law).

    A null text counts as an empty one: size 8, crc32 0, in the group of the empty texts. Repeated
    rows are rows of one group, each with a slot of its own. A null doc_id keeps its row. Only
    doc_id and text are read, so other columns may have any name. An empty table gives no rows.
    A group is never split: where one holds over a shard's even share, its shard holds it alone. Texts
    are measured whole, however long they are.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = settle(
        docs.select(
            F.col("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        ),
        "shard-rows",
    )
    groups = settle(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "shard-groups")
    count = rows.count()
    salts = parts(spark, count, slot_rows)
    shards = settle(assign_groups(groups, n_shards).join(groups.select("key", "n"), "key"), "shard-of-group")
    placed = settle(
        join_hot(rows, shards, ["key"], "n", count).select(
            "doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(salts)).alias("salt")
        ),
        "shard-placed",
    )
    before = Window.partitionBy("shard").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "salt")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    within = Window.partitionBy("shard", "salt").orderBy("doc_id", "size", "text_crc32")
    return (
        placed.withColumn("at", F.row_number().over(within) - 1)
        .join(starts, ["shard", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
