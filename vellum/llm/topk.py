"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers. The index stores blocks of rows: for every attribute and bit, a
bitmap over the block's rows. A query's scores in a block are the sum of its attributes' slices,
weighted by the query's signed binary digits and added with bitmap arithmetic (carry-save adders). The
result is again a stack of slices, from which the top rows are selected from the most significant
slice downward; rows that tie at the boundary are resolved by their exact score and their id.

Queries are dealt into groups of bounded size, and every group meets every block. A task keeps only
the best rows of the queries of one group at a time.

Quantised components travel as doubles, which hold them exactly. Vectors with large ones are stored in
blocks of their own, so that one outlier doesn't deepen the slices of all; numbers beyond a long are
Python integers there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import parts, settle

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Components of up to so many bits share blocks; beyond, vectors are grouped by so many bits more.
NARROW, STEP = 30, 32
#: Tasks that a search is dealt into, at most.
TASKS = 4096
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(values: np.ndarray) -> np.ndarray:
    """Integral doubles as longs, or as Python integers where one has more than 62 bits."""
    if not np.isfinite(values).all():
        raise OverflowError("a quantised component passes a double")
    if (np.abs(values) < 2.0**62).all():
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def slices_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lowest value of each attribute, bitmaps [attribute, bit, word]) of an integer matrix [row, attribute]."""
    rows, width = matrix.shape
    kind = object if matrix.dtype == object else np.uint64
    low = matrix.min(0) if rows else np.zeros(width, np.int64)
    shifted = (matrix - low).astype(kind)
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-rows // 64)
    padded = np.zeros((width, words * 64), kind)
    padded[:, :rows] = shifted.T
    one = kind(1) if kind is np.uint64 else 1
    stack = np.empty((width, bits, words), np.uint64)
    for b in range(bits):
        ones = ((padded >> (b * one)) & one).astype(np.uint8)
        stack[:, b] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64)
    return low if kind is object else low.astype(np.int64), stack


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(place, sign) of the nonadjacent form of an integer: the fewest signed powers of two."""
    out, place = [], 0
    while value:
        if value & 1:
            sign = 2 - (value & 3)
            out.append((place, sign))
            value -= sign
        value >>= 1
        place += 1
    return out


def add_slices(query: np.ndarray, low: np.ndarray, stack: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(base, slices): each row's inner product with ``query`` is base plus the number its slices spell."""
    width, bits, words = stack.shape
    base = int(sum(int(q) * int(x) for q, x in zip(query, low)))
    columns: dict[int, list[np.ndarray]] = {}
    for d in np.flatnonzero(query):
        for place, sign in signed_digits(int(query[d])):
            own = stack[d] if sign > 0 else ~stack[d]
            if sign < 0:  # -x = ~x - (2 ** bits - 1)
                base -= ((1 << bits) - 1) << place
            for b in range(bits):
                columns.setdefault(place + b, []).append(own[b])
    out: list[np.ndarray] = []
    at, last = 0, max(columns, default=-1)
    carry: list[np.ndarray] = []
    while at <= last or carry:
        maps = columns.get(at, []) + carry
        carry = []
        if not maps:
            out.append(np.zeros(words, np.uint64))
            at += 1
            continue
        column = np.stack(maps)
        while len(column) > 1:
            third = len(column) // 3
            if third:
                a, b, c, rest = column[:third], column[third : 2 * third], column[2 * third : 3 * third], column[3 * third :]
                both = a ^ b
                carry.extend((a & b) | (both & c))
                column = np.concatenate([both ^ c, rest])
            else:
                carry.append(column[0] & column[1])
                column = (column[0] ^ column[1])[None]
        out.append(column[0])
        at += 1
    return base, out


def _ones(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def top_rows(slices: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(surely in, tied at the boundary): bitmaps of the k highest of ``rows``, from the top slice down."""
    sure, tied = np.zeros_like(rows), rows.copy()
    if _ones(rows) <= k:
        return tied, sure
    for own in reversed(slices):
        wider = sure | (tied & own)
        count = _ones(wider)
        if count > k:
            tied &= own
        else:
            sure = wider
            tied &= ~own
            if count == k:
                tied = np.zeros_like(rows)
                break
    return sure, tied


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, low: np.ndarray, stack: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the block's k best rows for a query; ``ids`` ascend, the query's own rows are left out."""
    words = stack.shape[2]
    rows = np.full(words, FULL)
    if len(ids) % 64:
        rows[-1] = (np.uint64(1) << np.uint64(len(ids) % 64)) - np.uint64(1)
    for own in range(*np.searchsorted(ids, [query_id, query_id + 1])):
        rows[own >> 6] &= ~(np.uint64(1) << np.uint64(own & 63))
    base, slices = add_slices(query, low, stack)
    sure, tied = top_rows(slices, rows, k)
    found = _places(sure)
    found = np.concatenate([found, _places(tied)[: k - len(found)]]).astype(np.int64)
    kind = np.int64 if len(slices) <= 62 and abs(base) < 1 << 62 else object
    scores = np.full(len(found), base, kind)
    for place, own in enumerate(slices):
        scores += ((own[found >> 6] >> (found & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64).astype(kind) << place
    return ids[found], scores


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows by score, ties by id."""
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-int(scores[i]), ids[i]))[:k]
    else:
        order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _longs(scores: np.ndarray) -> pa.Array:
    """Scores as longs; null where one is below all longs, as it may yet turn out not to be among the best."""
    if scores.dtype != object:
        return pa.array(scores)
    values = [int(x) for x in scores]
    if any(x > MOST for x in values):  # then one of the query's final rows is beyond a long as well
        raise OverflowError("a score passes a long")
    return pa.array([x if x >= LEAST else None for x in values], pa.int64())


def _pack(kind: str):
    """A group's rows as one row: ids ascending and the matrix, both as bytes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        width = max(1, int(pdf["q"].map(len).max()))  # a vector of no components counts as zeros
        matrix = np.zeros((len(pdf), width), np.float64)
        for i, q in enumerate(pdf["q"]):
            matrix[i, : len(q)] = q
        ids = pdf["vec_id"].to_numpy(np.int64)
        if kind == "queries":
            return pd.DataFrame({"group": [int(pdf["group"].iloc[0])], "ids": [ids.tobytes()], "width": [width], "data": [matrix.tobytes()]})
        low, stack = slices_of(whole(matrix))
        low = low.astype(np.float64)
        return pd.DataFrame(
            {"block": [int(pdf["block"].iloc[0])], "ids": [ids.tobytes()], "width": [width], "low": [low.tobytes()], "bits": [stack.shape[1]], "data": [stack.tobytes()]}
        )

    return run


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        group = None

        def give():
            q = np.concatenate([np.full(len(v[0]), i, np.int64) for i, v in best.items()] or [np.empty(0, np.int64)])
            ids = np.concatenate([v[0] for v in best.values()] or [np.empty(0, np.int64)])
            scores = np.concatenate([v[1] for v in best.values()] or [np.empty(0, np.int64)])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), _longs(scores)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["group"] != group:
                    if best:
                        yield give()
                    best, group = {}, row["group"]
                ids = np.frombuffer(row["ids"], np.int64)
                low = whole(np.frombuffer(row["low"], np.float64))
                stack = np.frombuffer(row["data"], np.uint64).reshape(row["width"], row["bits"], -1)
                queries = np.frombuffer(row["q_data"], np.float64).reshape(-1, row["q_width"])
                same = min(row["width"], row["q_width"])
                for query_id, query in zip(np.frombuffer(row["q_ids"], np.int64).tolist(), queries):
                    own, scores = search_block(ids, low[:same], stack[:same], query_id, whole(query[:same]), k)
                    if query_id in best:
                        own, scores = np.concatenate([best[query_id][0], own]), np.concatenate([best[query_id][1], scores])
                        own, scores = _best(own, scores, k)
                    best[query_id] = own, scores
        if best:
            yield give()

    return run


def quantised(embeddings: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id, q (the components times ``scale`` rounded down, as doubles) and depth of the vectors that take part.

    depth is 0 where no component has more than NARROW bits, and grows by one with every STEP bits more.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False)))

    def down(v):  # doubles from 2 ** 53 on are integers, and a long wouldn't hold all of them
        y = v.cast("double") * scale
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)

    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, down).alias("q"))
    most = F.coalesce(F.array_max(F.transform("q", lambda v: F.abs(v))), F.lit(0.0))
    deep = F.least(F.floor((F.log2(most) - NARROW) / STEP), F.lit(1024 // STEP)).cast("int") + 1
    return rows.withColumn("depth", F.when(most <= F.lit(2.0**NARROW), F.lit(0)).otherwise(deep))


def search(embeddings: DataFrame, k: int = 20, every: int = 20, block_rows: int = 16_384, group_rows: int = 2_048) -> DataFrame:
    """The k best rows for every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score.

    The score is the integer inner product of the quantised vectors; ties go to the smaller vec_id.
    Vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without
    vec_id. A score among the k best that passes a long is an error. A shorter vector, an empty one too,
    counts as padded with zeros. All rows of the query's own vec_id are left out; repeated rows of
    another are listed each, while a repeated query counts once, by the first of its vectors in order
    of their components. Other columns are not read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    rows = settle(quantised(embeddings), "quantised")
    asked = settle(rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    groups = parts(spark, asked.count(), group_rows)
    # a row per depth, of which there are few; (first block, blocks) of each
    blocks, dealt = 0, {}
    for depth, n in sorted(rows.groupBy("depth").agg(F.count(F.lit(1))).collect()):
        dealt[depth] = blocks, parts(spark, n, block_rows)
        blocks += dealt[depth][1]
    block = F.lit(0).cast("long")
    for depth, (first, own) in dealt.items():
        block = F.when(F.col("depth") == depth, F.pmod(F.xxhash64("vec_id"), F.lit(own)) + first).otherwise(block)
    index = settle(
        rows.withColumn("block", block)
        .groupBy("block")
        .applyInPandas(_pack("index"), "block long, ids binary, width int, low binary, bits int, data binary"),
        "sliced-index",
    )
    asked = settle(
        asked.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
        .groupBy("group")
        .applyInPandas(_pack("queries"), "group long, ids binary, width int, data binary"),
        "query-groups",
    ).select("group", F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    # every group of queries against every block; the rows here are packed blocks, not vectors. A task
    # meets a run of blocks, so that it gives out each query's best of all of them once
    run = max(1, blocks * groups // TASKS)
    met = (
        index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        .join(asked, "group")
        .repartition(max(1, min(TASKS, blocks * groups)), "group", F.expr(f"block div {run}"))
        .sortWithinPartitions("group")
    )
    found = met.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "vec_id")
    score = F.coalesce("score", F.raise_error(F.lit("a score passes a long")).cast("long")).alias("score")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
