"""References between the blocks of a document, resolved where all of its blocks are.

A part is a row of session_id, ``blocks`` array<struct<id, ord, block_type, page, text, confidence, ...>> and
``edges`` array<struct<src, rtype, rpos, ipos, dst>>: a whole response, a page or a single block of it; ids hold
within a session. Spark brings a session's parts together once, and tasks resolve the references of many
sessions at a time by sorted numbers, so none costs a row of a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parts(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Parts of one block or one reference each."""
    own = [c for c in blocks.columns if c not in ("session_id", "relationships")]
    nodes = blocks.select("session_id", F.array(F.struct(*own)).alias("blocks"))
    links = edges.select("session_id", F.array(F.struct("src", "rtype", "rpos", "ipos", "dst")).alias("edges"))
    return nodes.unionByName(links, allowMissingColumns=True)


def order_type(parts: DataFrame) -> str:
    """The type of what keeps the order of blocks, a number or a struct."""
    return parts.schema["blocks"].dataType.elementType["ord"].dataType.simpleString()


def resolve(parts: DataFrame, told: Callable[[Graph], dict], schema: str) -> DataFrame:
    """What ``told`` says of whole sessions, as rows of ``schema``.

    The count of a session's parts brings them into one task, one behind the other, and tells where they end.
    Parts that are dealt out and sorted by session already are neither shuffled nor sorted again.
    """
    together = parts.where("session_id IS NOT NULL").select(
        "session_id", "blocks", "edges", F.count(F.lit(1)).over(Window.partitionBy("session_id")).alias("n_parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_sessions(batches):
            yield pa.RecordBatch.from_pydict(told(Graph(rows)))

    return together.mapInArrow(run, schema)


def whole_sessions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut only where a session ends."""
    held, missing = [], 0  # the start of a session, and how many rows it goes on for
    for batch in batches:
        n, size = batch["n_parts"].to_numpy(), batch.num_rows
        cut = end = missing
        while end < size:
            cut, end = end, end + int(n[end])
        missing = end - size
        if not missing:
            cut = size
        if cut > size:
            held.append(batch)
            continue
        held.append(batch.slice(0, cut))
        if any(b.num_rows for b in held):
            yield pa.concat_batches(held)
        held = [batch.slice(cut)]


def meet(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal numbers stand in ``left`` and in ``right``, a pair of places each; -1 meets nothing."""
    order = np.argsort(right, kind="stable")
    ranked = right[order]
    first = np.searchsorted(ranked, left, "left")
    n = np.where(left < 0, 0, np.searchsorted(ranked, left, "right") - first)
    return np.repeat(np.arange(len(left)), n), order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def looked_up(wanted: np.ndarray, known: np.ndarray, values: pa.Array) -> pa.Array:
    """For each of ``wanted`` its value, or null; ``known`` is in order and without doubles."""
    if not len(known):
        return pa.nulls(len(wanted), values.type)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return values.take(pa.array(at, mask=known[at] != wanted))


class Graph:
    """The blocks and references of some sessions; an id becomes a number that holds among them (-1: none)."""

    def __init__(self, rows: pa.RecordBatch):
        blocks, edges = rows["blocks"], rows["edges"]
        sessions = rows["session_id"].dictionary_encode()
        self.sessions = sessions.dictionary
        self.blocks, self.edges = pa.RecordBatch.from_struct_array(blocks.flatten()), pa.RecordBatch.from_struct_array(edges.flatten())
        self.block_session, edge_session = (sessions.indices.take(pc.list_parent_indices(x)) for x in (blocks, edges))
        ids = pa.concat_arrays([self.blocks["id"], self.edges["src"], self.edges["dst"]]).dictionary_encode()
        owner = np.concatenate([x.to_numpy().astype(np.int64) for x in (self.block_session, edge_session, edge_session)])
        known = np.asarray(pc.fill_null(ids.indices, -1)).astype(np.int64)
        numbers = np.where(known < 0, -1, owner * len(ids.dictionary) + known)
        self.id, self.src, self.dst = np.split(numbers, [len(self.block_session), len(self.block_session) + len(edge_session)])

    def kind(self, name: str) -> np.ndarray:
        """The places of blocks of one type."""
        return np.flatnonzero(pc.fill_null(pc.equal(self.blocks["block_type"], name), False))

    def links(self, name: str) -> np.ndarray:
        """The places of references of one type."""
        return np.flatnonzero(pc.fill_null(pc.equal(self.edges["rtype"], name), False) & (self.src >= 0))

    def sessions_of(self, blocks: np.ndarray) -> pa.Array:
        return self.sessions.take(self.block_session.take(pa.array(blocks)))

    def in_order(self, links: np.ndarray, *then: pa.Array) -> np.ndarray:
        """How to sort references by where they are from, and by their positions there."""
        keys = [pa.array(self.src[links]), *[self.edges[c].take(pa.array(links)) for c in ("rpos", "ipos")], *then]
        names = [str(i) for i in range(len(keys))]
        return pc.sort_indices(pa.RecordBatch.from_arrays(keys, names), [(n, "ascending") for n in names], null_placement="at_start").to_numpy()

    def texts(self) -> tuple[np.ndarray, pa.Array]:
        """Blocks with words below them, in order of their numbers, and the words, joined by a space."""
        child, words = self.links("CHILD"), self.kind("WORD")
        of, at = meet(self.dst[child], self.id[words])
        links, text = child[of], pc.fill_null(self.blocks["text"].take(pa.array(words[at])), "")
        order = self.in_order(links, text)
        src, text = self.src[links[order]], text.take(pa.array(order))
        nodes, first = np.unique(src, return_index=True)
        own = pa.ListArray.from_arrays(pa.array(np.append(first, len(src)), pa.int32()), text)
        return nodes, pc.binary_join(own, " ")
