"""Conversation prefix trie, merged from partial tries.

Each distinct sequence of first turns is a node. A turn becomes a 128-bit key, a node the sum (in two
lanes of 64 bits, modulo 2^64) of the hashes of its turns' keys and places: sums of neighbouring pieces
add up, so even one conversation may be dealt over many tasks. Rows are dealt in ranges of
(conversation, place); a task combines its rows into a node table, a partial trie with members counted
and the ids of conversations that end at a node in ascending order. Only a conversation that began in an
earlier range has nodes that lack the sum so far: they stay loose until the ranges' last sums, one a
range, are known. The partial tables are merged in a tree, keyed by node and group of ranges. Subtrees
are rolled up from the bottom with steps that double, over the nodes of two or more members only: below
a node of one member there is a single chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import join_hot, numbered, settle

#: Rows that a task combines at a time, ids in a piece of an end list, partial tables merged at a time.
CHUNK, PIECE, FAN = 200_000, 1024, 256
PARTIAL = "kind int, part long, conv_id long, depth long, bytes long, n long, id binary, parent binary, first_end long, ends string"
NODE, LOOSE, TAIL, END = range(4)


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a turn; the role's length keeps its border with the text."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, p, key, bytes): the turns of each conversation, p from 0 in order of turn, nulls first.

    Null roles and texts are empty. Turns of one number follow each other by their key. Rows without a
    conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(role, text).alias("key"), F.octet_length(text).cast("long").alias("bytes")
    )
    placed = numbered(rows, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")], "g", "trie-turns")
    starts = settle(placed.groupBy("conv_id").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "trie-starts")
    total = starts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = join_hot(placed, starts, ["conv_id"], "n", total)
    return joined.select("conv_id", (F.col("g") - F.col("start")).alias("p"), "key", "bytes")


def whole(turns: DataFrame) -> DataFrame:
    """The steps of ``turns`` as they are: see ``prefix_trie``."""
    counts = settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), "trie-totals")
    rows = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    told = join_hot(turns, counts.withColumn("n", F.col("total")), ["conv_id"], "n", rows)
    return told.select("conv_id", F.col("p").alias("pos"), "key", "bytes", "total").unionByName(_roots(counts))


def with_shared_heads(turns: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """Steps of rebuilt conversations: the first h turns of c - c % ``group``, then those of c after its first h.

    h is the CRC-32 of c's decimal digits modulo ``most``. c % ``group`` has the sign of c.
    """
    turns = settle(turns, "trie-own")
    heads = (
        turns.where((F.col("conv_id") % group == 0) & (F.col("p") < most - 1))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("p", "key", "bytes"))).alias("head"))
    )
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    plan = convs.join(heads, "base", "left").withColumn("head", F.expr("coalesce(slice(head, 1, int(h)), array())"))
    given = F.size("head").cast("long")
    plan = settle(
        plan.select("conv_id", "n", "h", "head", (F.col("h") - given).alias("shift"), (given + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")),
        "trie-plan",
    )
    rows = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_hot(turns, plan.select("conv_id", "n", "h", "shift", "total"), ["conv_id"], "n", rows).where("p >= h")
    own = own.select("conv_id", (F.col("p") - F.col("shift")).alias("pos"), "key", "bytes", "total")
    first = plan.select("conv_id", "total", F.explode("head").alias("t"))
    first = first.select("conv_id", F.col("t.p").alias("pos"), "t.key", "t.bytes", "total")
    return own.unionByName(first).unionByName(_roots(plan))


def _roots(counts: DataFrame) -> DataFrame:
    """A step without a turn for each conversation, at the root."""
    return counts.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(b"").alias("key"), F.lit(0).cast("long").alias("bytes"), "total")


def _ids(a: np.ndarray, b: np.ndarray) -> pa.Array:
    data = np.stack([a, b], 1).astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(16), len(a), [None, pa.py_buffer(data)]).cast(pa.binary())


def _rows(kind: int, part: int, conv, depth, size, n, ids, parents, first=None, ends=None) -> pa.RecordBatch:
    rows = len(conv)
    fill = lambda x: pa.array(np.full(rows, x, np.int64))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, kind, np.int32)), fill(part), pa.array(conv), fill(0) if depth is None else pa.array(depth),
            fill(0) if size is None else pa.array(size), fill(1) if n is None else pa.array(n), ids, parents,
            pa.nulls(rows, pa.int64()) if first is None else pa.array(first, pa.int64()), pa.nulls(rows, pa.string()) if ends is None else pa.array(ends, pa.string()),
        ],
        names=[c.split()[0] for c in PARTIAL.split(", ")],
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node tables of a range of steps in order, its loose nodes, and the sum at which its last conversation stands."""
    part = TaskContext.get().partitionId()
    last = None  # (conversation, both sums, whether it began in an earlier range)
    for table in _chunks(batches):
        conv, pos, size, total = (table.column(c).to_numpy() for c in ("conv_id", "pos", "bytes", "total"))
        lanes = [table.column(c).to_numpy().view(np.uint64) for c in ("a", "b")]
        rows = np.arange(len(conv))
        begins = np.concatenate([[True], conv[1:] != conv[:-1]])
        start = np.maximum.accumulate(np.where(begins, rows, 0))
        goes_on = last is not None and last[0] == conv[0]
        loose = last[3] if goes_on else pos[0] >= 0
        sums = []
        for k, lane in enumerate(lanes):
            run = np.cumsum(lane, dtype=np.uint64)
            run -= (run - lane)[start]
            if goes_on:
                run[start == 0] += last[1 + k]
            sums.append(run)
        above = [s - lane for s, lane in zip(sums, lanes)]
        ended = pos + 1 == total
        head = (start == 0) & loose
        if head.any():
            own = np.flatnonzero(head)
            ids, parents = _ids(*(s[own] for s in sums)), _ids(*(s[own] for s in above))
            yield _rows(LOOSE, part, conv[own], pos[own] + 1, size[own], None, ids, parents, conv[own], [str(c) if e else None for c, e in zip(conv[own], ended[own])])
        rest = np.flatnonzero(~head)
        if len(rest):
            order = rest[np.lexsort((sums[1][rest], sums[0][rest]))]  # stable: the first of a node is its smallest conversation
            a, b = sums[0][order], sums[1][order]
            new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            at = np.flatnonzero(new)
            first = order[at]
            parents = _ids(above[0][first], above[1][first])
            yield _rows(NODE, part, conv[first], pos[first] + 1, size[first], np.diff(np.append(at, len(order))), _ids(a[at], b[at]), parents)
            done = np.flatnonzero(ended[order])
            if len(done):
                node = np.cumsum(new)[done]
                cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
                spans = [(i, min(i + PIECE, hi)) for lo, hi in zip(cut, np.append(cut[1:], len(done))) for i in range(lo, hi, PIECE)]
                ids = conv[order][done]
                where = done[[i for i, _ in spans]]
                yield _rows(END, part, ids[[i for i, _ in spans]], None, None, None, _ids(a[where], b[where]), _ids(a[where], b[where]),
                            ids[[i for i, _ in spans]], [",".join(map(str, ids[i:j])) for i, j in spans])
        last = (conv[-1], sums[0][-1], sums[1][-1], bool(head[-1]))
    if last is not None:
        ids = _ids(*(np.array([s], np.uint64) for s in last[1:3]))
        yield _rows(TAIL, part, np.array([last[0]]), np.array([int(last[3])]), None, None, ids, ids)


def _fixed(loose: DataFrame, offsets: dict[int, tuple[int, int]]) -> DataFrame:
    """``loose`` nodes with the sums that their conversation had before their range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            add = np.array([offsets[p] for p in parts], np.uint64).reshape(-1, 2)
            columns = list(batch.columns)
            for c in (6, 7):
                raw = np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u8").reshape(-1, 2).astype(np.uint64) + add
                columns[c] = _ids(raw[:, 0], raw[:, 1])
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return loose.mapInArrow(run, PARTIAL)


def _offsets(tails: list) -> dict[int, tuple[int, int]]:
    """For every range, the sums of the conversation that reaches into it; ``tails`` has a row a range."""
    out, now, parts = {}, (0, 0), max((t["part"] for t in tails), default=-1) + 1
    by_part = {t["part"]: t for t in tails}
    for part in range(parts):
        out[part] = now
        if part in by_part:
            tail = by_part[part]
            own = tuple(int.from_bytes(tail["id"][i : i + 8], "big") for i in (0, 8))
            now = tuple((x + y) % 2**64 for x, y in zip(now, own)) if tail["depth"] else own
    return out


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """One row a node, (id, parent, depth, bytes, n, conv_id), from partial tables: FAN neighbouring ones at a time."""
    now = partial.select("id", "parent", "depth", "bytes", "n", "conv_id", "part")
    while True:
        parts = -(-parts // FAN)
        now = now.groupBy("id", F.expr(f"part div {FAN}").alias("part")).agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
        )
        if parts <= 1:
            return now.drop("part")


def _digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): the end lists' pieces hashed in order as they stream by, none held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            found = []
            for node, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != now:
                    if now is not None:
                        found.append((now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.binary()), pa.array([d for _, d in found], pa.string())], names=["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

    ordered = ends.select("id", "first_end", "ends").repartition("id").sortWithinPartitions("id", "first_end")
    return ordered.mapInArrow(run, "id binary, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(id, leaves, saved) summed over subtrees, from (id, parent, leaves, saved) of a tree's nodes.

    After round k a node has the sums of its subtree down to a distance under 2^k and knows its
    ancestor at the distance 2^k, to which those sums go next: as many rounds as the depth has digits.
    """
    state = settle(nodes.select("id", F.col("parent").alias("up"), "leaves", "saved"), "trie-round")
    while True:
        sent = state.where("up IS NOT NULL").groupBy("up").agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"), F.count(F.lit(1)).alias("m"))
        sent = settle(sent, "trie-sent")
        rows = sent.agg(F.sum("m")).first()[0]
        if not rows:
            return state.drop("up")
        above = state.where("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("next")).join(sent.select("up", "m"), "up")
        next_up = join_hot(state.where("up IS NOT NULL").select("id", "up"), above, ["up"], "m", rows).select("id", "next")
        grown = state.drop("up").join(sent.drop("m").withColumnRenamed("up", "id"), "id", "left").join(next_up, "id", "left")
        state = settle(
            grown.select(
                "id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
            ),
            "trie-round",
        )


def prefix_trie(steps: DataFrame) -> DataFrame:
    """The nodes of the trie of ``steps``: (conv_id, pos, key, bytes, total), total a conversation's turns.

    Each conversation has a step at pos -1, the root, and one at every pos from 0 to total - 1; key
    stands for the turn and bytes is the size of its text. Returns conv_id (the smallest member), depth,
    parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and ends_sha256, one
    row a node. Without conversations there is no node. Nodes are told apart by 128 bits.

    A list of ends is hashed in one pass, as SHA-256 can't be split; the pieces of the list pass through
    one task in order, without being held.
    """
    a = F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("pos", "key"))
    b = F.when(F.col("pos") < 0, F.lit(0).cast("long")).otherwise(F.xxhash64("key", "pos"))
    rows = steps.select("conv_id", "pos", "bytes", "total", a.alias("a"), b.alias("b"))
    dealt = rows.repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")
    partial = settle(dealt.mapInArrow(partial_tries, PARTIAL), "trie-partial")
    # a row for each range
    tails = partial.where(F.col("kind") == TAIL).select("part", "conv_id", "depth", "id").collect()
    fixed = _fixed(partial.where(F.col("kind") == LOOSE), _offsets(tails))
    tables = partial.where(F.col("kind") == NODE).unionByName(fixed)
    nodes = settle(merged(tables, len(tails) and max(t["part"] for t in tails) + 1), "trie-merged")
    nodes = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent")))
    kids = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(
        F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n") == 1).alias("single")
    )
    nodes = nodes.join(kids, "id", "left").na.fill(0, ["n_children", "single"])
    nodes = settle(
        nodes.withColumn("leaves", F.col("single") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes")), "trie-nodes"
    )
    sums = rolled_up(nodes.where("n > 1"))
    chain = nodes.where("n = 1").select("id", F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    ends = partial.where(F.col("kind") == END).unionByName(fixed.where("ends IS NOT NULL"))
    count = nodes.count()
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("m"))
    below = join_hot(nodes.where("parent IS NOT NULL"), parents, ["parent"], "m", count)
    tree = below.unionByName(nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    told = tree.drop("leaves", "saved").join(sums.unionByName(chain), "id").join(_digests(ends), "id", "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def trie_of(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations`` (conv_id, turn, role, text; other columns aren't read) as they are.

    Repeated rows are turns like others. See ``turns_of`` for nulls and ties, ``prefix_trie`` for the rest.
    """
    return prefix_trie(whole(turns_of(conversations)))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The prefix trie of ``conversations`` with shared heads; see ``with_shared_heads``."""
    return prefix_trie(with_shared_heads(turns_of(conversations)))
