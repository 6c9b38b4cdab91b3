"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint holds, for each of its bits, the majority over the hashes of a document's word shingles.
In a bucket, fingerprints are stored as vertical bit planes, 64 of them to a machine word; a
fingerprint's distances to all of a word's lanes grow together in carry-save counters, and a word is
abandoned as soon as all its lanes are beyond the radius.

``near_duplicates`` links fingerprints of 64 bits at most 4 bits apart, and loses no link: such a pair
agrees on all but 4 of any number of bit blocks, so buckets are made for every choice of the other
blocks. The number of blocks grows with the corpus, so that buckets stay small.

``keep_first`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
That is some 39 of 256 bits, too many for blocks, so buckets are made by tables of sampled bits, as
many as find a pair at 0.8 with the probability ``RECALL``. What a bucket holds within the radius is
spanned by a few forests of least distance, whose links are checked against the shingles. A crowd of which
the forests left pairs out and whose texts the checked links don't join is then compared whole, by shingles.

Large buckets and crowds are dealt into chunks, and every pair of chunks is compared.

Neither emits the pairs of a bucket, only spanning forests.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import HOT_KEYS, fresh, join_hot, settle, settled
from vellum.llm.components import components

BITS, RADIUS = 64, 4
#: A bucket of more fingerprints is cut into chunks of about this many.
CHUNK = 4096
#: Unrelated fingerprints that a bucket may hold on average.
CROWD = 512
#: The stage's shingles, similarity, bits, and the part of pairs at just this similarity that the tables meet.
WORDS, ALIKE, WIDE, RECALL = 5, 0.8, 256, 0.99
#: Forests over a bucket: if a link of one turns out to be below ALIKE, the next ones hold other links across the same gap.
LAYERS = 4
#: A crowd of more texts is compared by their shingles in chunks of about this many.
PART = 1024
#: Bits in which hashes of a pair at ALIKE differ on average, and the radius: over three standard deviations more.
APART = math.acos(2 * ALIKE / (1 + ALIKE)) / math.pi
REACH = math.ceil(WIDE * APART + 3.3 * math.sqrt(WIDE * APART * (1 - APART)))


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of a whole text, A-Z lower-cased; of all words where they are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    count = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if count <= 1:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:count].tolist()
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, count)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The majority of each bit, as 64-bit words; ``hashes`` [shingle, word]. Zero without shingles."""
    count, width = hashes.shape
    ones = np.zeros(64 * width, np.int64)
    for at in range(0, count, 255):  # as many as a byte can count
        part = np.ascontiguousarray(hashes[at : at + 255]).view(np.uint8).reshape(-1, 8 * width)
        ones += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > count, bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The unsigned fingerprint of one whole text in UTF-8; 0 where there is no word."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None])[0])


def wide_fingerprint(text: bytes, shingle: int = WORDS, seed: int = 42) -> tuple[bytes, np.ndarray]:
    """(fingerprint of WIDE bits over the distinct shingles, their hashes cut to 32 bits)."""
    own = np.unique(shingle_hashes(text, shingle, seed))
    spread = np.empty((len(own), WIDE // 64), np.uint64)
    for k in range(spread.shape[1]):
        x = (own + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        spread[:, k] = x ^ (x >> np.uint64(31))
    return majority(spread).tobytes(), np.unique((own >> np.uint64(32)).astype(np.uint32)).view(np.int32)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text) and fp (the fingerprint as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"") for t in batch.column(2).to_pylist()]
            own = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own], names=["doc_id", "mark", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, fp long")


def blocks_for(rows: int) -> int:
    """How many bit blocks keep buckets of unrelated fingerprints small: from 6 (keys of 21 bits) to 9."""
    blocks = RADIUS + 2
    while blocks < 9 and rows > CROWD << (BITS * (blocks - RADIUS) // blocks):
        blocks += 1
    return blocks


def _block_keys(blocks: int) -> list:
    """For each choice of all but RADIUS blocks, the fingerprint's bits in them and the choice's number, as one long."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(number).cast("long")
        for block in chosen:
            width = edges[block + 1] - edges[block]
            own = F.shiftrightunsigned("fp", edges[block]).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
            key = F.shiftleft(key, width).bitwiseOR(own)
        keys.append(key)
    return keys


def _carry_save(a, b, c):
    both = a ^ b
    return both ^ c, (a & b) | (both & c)


def near(values: np.ndarray, ends: np.ndarray, radius: int = RADIUS, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places (i, j), i < j < ends[i], of values at most ``radius`` bits apart, a block at a time.

    ``values`` are 64-bit words, or rows of them. ``ends[i]`` is the end of the bucket of place i;
    buckets are contiguous.
    """
    n = len(values)
    values = values.reshape(n, -1)
    width = 64 * values.shape[1]
    words = -(-n // 64)
    bits = np.zeros((words * 64, width), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    planes = np.ascontiguousarray(planes).view(np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    place = np.arange(n)
    first, last = (place + 1) >> 6, (ends - 1) >> 6
    spans = np.where(place + 1 < ends, last - first + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(spans)])
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1)
        own = spans[at:to]
        total = int(own.sum())
        if total:
            i = np.repeat(place[at:to], own)
            w = np.arange(total) - np.repeat(bounds[at:to] - bounds[at], own) + np.repeat(first[at:to], own)
            low, high = np.clip(i + 1 - w * 64, 0, 63), np.clip(ends[i] - w * 64, 1, 64)
            over = ~((full << low.astype(np.uint64)) & (full >> (64 - high).astype(np.uint64)))
            # a counter of as many slices as the radius has bits, three at least; what passes it is over
            count = [np.zeros(total, np.uint64) for _ in range(max(3, radius.bit_length()))]
            for p in range(0, width, 8):
                mine = values[i, p >> 6]
                x = [planes[p + k][w] ^ (np.uint64(0) - ((mine >> np.uint64((p + k) & 63)) & np.uint64(1))) for k in range(8)]
                count[0], two_a = _carry_save(count[0], x[0], x[1])
                count[0], two_b = _carry_save(count[0], x[2], x[3])
                count[1], four_a = _carry_save(count[1], two_a, two_b)
                count[0], two_a = _carry_save(count[0], x[4], x[5])
                count[0], two_b = _carry_save(count[0], x[6], x[7])
                count[1], four_b = _carry_save(count[1], two_a, two_b)
                count[2], carry = _carry_save(count[2], four_a, four_b)
                for t in range(3, len(count)):
                    count[t], carry = count[t] ^ carry, count[t] & carry
                over |= carry
                beyond = _beyond(over, count, radius)
                live = beyond != full
                if p + 8 == width or live.sum() < 0.75 * len(live):
                    i, w, over, beyond = i[live], w[live], over[live], beyond[live]
                    count = [c[live] for c in count]
                    if not len(i):
                        break
            if len(i):
                lanes = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                cell, lane = np.nonzero(lanes)
                yield i[cell], w[cell] * 64 + lane
        at = to


def _beyond(over: np.ndarray, count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count passes ``radius``, compared slice by slice from the top."""
    more, same = over.copy(), ~over
    for t in range(len(count) - 1, -1, -1):
        if radius >> t & 1:
            same = same & count[t]
        else:
            more |= same & count[t]
            same = same & ~count[t]
    return more


def join_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Make ``labels`` (each place's smallest linked place) hold for the links i, j as well."""
    while len(i):
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            shorter = labels[labels]
            if (shorter == labels).all():
                break
            labels[:] = shorter


def _cells(links: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], key: int):
    """Call ``links`` (ids, values, end of each place's cell) for whole cells, many at a time.

    Rows come sorted by cell, their first ``key`` columns; an id and the value follow.
    """

    def ends_of(cells: np.ndarray) -> np.ndarray:
        change = np.flatnonzero((cells[1:] != cells[:-1]).any(1)) + 1
        starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(cells)]])
        return np.repeat(ends, ends - starts)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ids, values = None, None, None
        for batch in batches:
            own = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(key)], 1)
            node = batch.column(key).to_numpy(zero_copy_only=False)
            value = batch.column(key + 1)
            if pa.types.is_binary(value.type):
                value = np.frombuffer(b"".join(value.to_pylist()), np.uint64).reshape(len(own), -1)
            else:
                value = value.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
            cells, ids, values = (own, node, value) if cells is None else (np.concatenate([x, y]) for x, y in ((cells, own), (ids, node), (values, value)))
            if len(cells) >= 1 << 15:
                ends = ends_of(cells)
                cut = int(np.flatnonzero(ends < len(cells))[-1]) + 1 if ends[0] < len(cells) else 0
                if cut:
                    yield links(ids[:cut], values[:cut], ends[:cut])
                    cells, ids, values = cells[cut:], ids[cut:], values[cut:]
        if cells is not None and len(cells):
            yield links(ids, values, ends_of(cells))

    return go


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _forest(ids: np.ndarray, values: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Links that span the components within every cell."""
    labels = np.arange(len(ids))
    for i, j in near(values, ends):
        join_labels(labels, i, j)
    moved = np.flatnonzero(labels != np.arange(len(ids)))
    return _links(ids[moved], ids[labels[moved]])


def spanning(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which of the links i, j make the spanning forest of least ``apart`` over n places; of equals, the first by i, j."""
    order = np.lexsort((j, i, apart))
    labels, chosen = np.arange(n), []
    while True:
        a, b = labels[i[order]], labels[j[order]]
        order, a, b = order[a != b], a[a != b], b[a != b]
        if not len(order):
            return np.concatenate([*chosen, order])
        rank, least = np.arange(len(order)), np.full(n, len(order))
        np.minimum.at(least, a, rank)
        np.minimum.at(least, b, rank)
        pick = order[np.unique(least[least < len(order)])]
        chosen.append(pick)
        join_labels(labels, i[pick], j[pick])


def layered(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, layers): the links of the forest of least distance, of that over the other links, and so on, LAYERS in all."""
    left, places, layers = np.arange(len(i)), [], []
    for layer in range(LAYERS):
        keep = spanning(n, i[left], j[left], apart[left])
        places.append(left[keep])
        layers.append(np.full(len(keep), layer))
        left = np.delete(left, keep)
    return np.concatenate(places), np.concatenate(layers)


def _closest(ids: np.ndarray, values: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """The layered forests over the pairs within REACH of every cell, and the crowds that they leave pairs out of.

    A crowd is what such pairs join; its texts are told as links of the layer -1 to its first one.
    """
    i = j = apart = layer = np.empty(0, np.int64)
    short = np.zeros(len(ids), bool)
    for a, b in near(values, ends, REACH):
        far = np.bitwise_count(values[a] ^ values[b]).sum(1, dtype=np.int64)
        i, j, apart = np.concatenate([i, a]), np.concatenate([j, b]), np.concatenate([apart, far])
        keep, layer = layered(len(ids), i, j, apart)
        short[np.delete(i, keep)] = True
        i, j, apart = i[keep], j[keep], apart[keep]
    labels = np.arange(len(ids))
    join_labels(labels, i, j)
    crowded = np.zeros(len(ids), bool)
    crowded[labels[short]] = True
    member = np.flatnonzero(crowded[labels])
    u, v = np.concatenate([np.minimum(ids[i], ids[j]), ids[member]]), np.concatenate([np.maximum(ids[i], ids[j]), ids[labels[member]]])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (u, v, np.concatenate([layer, np.full(len(member), -1)]))], names=["u", "v", "layer"])


def shared(texts: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two of ``texts`` (their distinct shingles) have in common."""
    n = len(texts)
    bound = max(8, n // 32)
    found, code, often = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    at = np.repeat(np.arange(n), [len(x) for x in texts])
    out = np.zeros((n, n), np.float32)
    # shingles of many texts by products of matrices, so many at a time; counts are exact as floats
    many = np.flatnonzero(often > bound)
    for k in range(0, len(many), 2048):
        place = np.full(len(found), -1)
        place[many[k : k + 2048]] = np.arange(len(many[k : k + 2048]))
        own = place[code] >= 0
        has = np.zeros((n, len(many[k : k + 2048])), np.float32)
        has[at[own], place[code[own]]] = 1
        out += has @ has.T
    # of few texts: the texts of one shingle lie together, each meets those some places behind it
    few = (often > 1) & (often <= bound)
    own = few[code]
    order = np.argsort(code[own], kind="stable")
    codes, ats = code[own][order], at[own][order]
    for step in range(1, int(often[few].max()) if few.any() else 1):
        meet = np.flatnonzero(codes[step:] == codes[:-step])
        np.add.at(out, (ats[meet], ats[meet + step]), 1)
        np.add.at(out, (ats[meet + step], ats[meet]), 1)
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) that span what is alike in every cell; rows (label, a, b, node, root, shingles) come sorted by cell.

    Texts of one root are joined already.
    """

    def links(rows: list[tuple]) -> pa.RecordBatch:
        ids, roots = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        if (roots == roots[0]).all():
            return _links(ids[:0], ids[:0])
        sizes, both = np.array([len(r[2]) for r in rows]), shared([r[2] for r in rows])
        alike = 100 * both >= round(100 * ALIKE) * (sizes[:, None] + sizes - both)
        i, j = np.nonzero(np.triu(alike & (roots[:, None] != roots), 1))
        keep = spanning(len(ids), i, j, np.zeros(len(i), np.int64))
        return _links(ids[i[keep]], ids[j[keep]])

    cell, rows = None, []
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
        nodes, roots, shingles = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
        flat, ends = shingles.values.to_numpy(), shingles.offsets.to_numpy()
        for k, own in enumerate(keys):
            if own != cell and rows:
                yield links(rows)
                rows = []
            cell = own
            rows.append((nodes[k], roots[k], flat[ends[k] : ends[k + 1]]))
    if rows:
        yield links(rows)


def _classes(marked: DataFrame) -> DataFrame:
    """fp, component_id (its smallest doc_id) and n (its rows) for every fingerprint of ``marked`` (doc_id, fp)."""
    nodes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "fp-nodes")
    count = nodes.count()
    keyed = nodes.select("fp", F.explode(F.array(*_block_keys(blocks_for(count)))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.expr(f"(n + {CHUNK - 1}) div {CHUNK}")
    dealt = keyed.join(sizes, "key").select("fp", "key", F.pmod(F.xxhash64("fp"), chunks).alias("own"), chunks.alias("chunks"))
    # every pair of a bucket's chunks is compared
    cells = dealt.select("key", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"), "fp").select(
        "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp", F.col("fp").alias("value")
    )
    spans = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "fp").mapInArrow(_cells(_forest, 3), "u long, v long")
    roots = components(spans).withColumnRenamed("u", "fp")
    rooted = settle(nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "fp-rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("own"))
    return join_hot(rooted, least, ["root"], "own", count).select("fp", "component_id", "n")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of every row.

    Words are maximal runs without ASCII white space, A-Z lower-cased; shingles are of four words
    (fewer words: all of them). A text that is null or has no word has fingerprint zero and is linked
    like any other. Fingerprints at most 4 bits apart are linked; component_id is the smallest doc_id
    that links reach. Texts are read whole however long they are; one text has to fit into a task.
    Repeated rows are rows like others; a row of null doc_id takes part but is never a component's
    smallest (a component of such rows only has a null component_id). Other columns are not read. An
    empty table gives no rows.
    """
    marked = settle(fingerprints(docs), "fingerprints")
    classes = settled(docs.sparkSession, lambda: _classes(marked.select("doc_id", "fp")), "fp-classes")
    return join_hot(marked, classes, ["fp"], "n", marked.count()).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _wide_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), fp (WIDE bits) and shingles (sorted 32-bit hashes) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [wide_fingerprint(t or b"") for t in part.column(2).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for _, x in found])]).astype(np.int32)
                shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x for _, x in found])))
                columns = [part.column(0), part.column(1), pa.array([f for f, _ in found], pa.binary()), shingles]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "fp", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, fp binary, shingles array<int>")


def tables_for(rows: int) -> list[np.ndarray]:
    """The sampled bits of each table: so many that a bucket holds about CROWD unrelated fingerprints."""
    depth = max(0, math.ceil(math.log2(max(1, rows) / CROWD)))
    met = (1 - APART) ** depth
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - met)) if depth else 1
    return [np.random.default_rng([depth, t]).permutation(WIDE)[:depth] for t in range(tables)]


def _candidates(nodes: DataFrame, count: int) -> DataFrame:
    """Links (u, v, layer) that span what the tables' buckets hold within REACH, and crowds; ``nodes`` are (node, fp)."""
    tables = tables_for(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                prints = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                bits = np.unpackbits(prints, axis=1, bitorder="little")
                for t, own in enumerate(tables):
                    keys = bits[:, own].astype(np.int64) @ (np.int64(1) << np.arange(len(own)))
                    columns = [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys), part.column(0), part.column(1)]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "key", "node", "fp"])

    keyed = nodes.select("node", "fp").mapInArrow(run, "t int, key long, node long, fp binary")
    # every pair of a large bucket's chunks is compared
    chunks = F.lit(1).cast("long")
    if count > CHUNK:
        hot = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
        keyed = keyed.join(settle(hot, "hot-buckets"), ["t", "key"], "left")
        chunks = F.coalesce(F.expr(f"(n + {CHUNK - 1}) div {CHUNK}"), chunks)
    cells = _chunk_pairs(keyed, ["t", "key"], chunks, ["node", "fp"]).repartition("t", "key", "a", "b")
    spans = cells.sortWithinPartitions("t", "key", "a", "b", "node").mapInArrow(_cells(_closest, 4), "u long, v long, layer long")
    # a pair may be a link of one table and the crowd of another
    return spans.groupBy("u", "v", (F.col("layer") < 0).alias("crowd")).agg(F.min("layer").alias("layer")).drop("crowd")


def _chunk_pairs(rows: DataFrame, keys: list[str], chunks: Column, values: list[str]) -> DataFrame:
    """``keys``, a, b and ``values``: the rows (of a node) of each key's chunks with those of every other of its chunks."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    dealt = rows.select(*keys, *values, chunks.alias("chunks")).select(*keys, *values, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    return dealt.select(*keys, F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), *values)


def _crowd_links(crowds: DataFrame, roots: DataFrame, shingles: DataFrame) -> DataFrame:
    """Links (u, v) of all that is alike in ``crowds`` (node, label) and that ``roots`` (u, root) don't join."""
    known = roots.withColumnRenamed("u", "node")
    rooted = settle(crowds.join(known, "node", "left").select("label", "node", F.coalesce("root", "node").alias("root")), "crowds")
    sizes = rooted.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    apart = settle(sizes.where("low < high").select("label", "n", F.expr(f"(n + {PART - 1}) div {PART}").alias("chunks")), "crowds-apart")
    dealt = join_hot(rooted, apart, ["label"], "n", rooted.count())
    cells = _chunk_pairs(dealt, ["label"], F.col("chunks"), ["node", "root"]).join(shingles, "node")
    cells = cells.select("label", "a", "b", "node", "root", "shingles").repartition("label", "a", "b")
    return cells.sortWithinPartitions("label", "a", "b", "node").mapInArrow(_whole, "u long, v long")


def _alike(links: DataFrame, shingles: DataFrame, per_task: int = 1000) -> DataFrame:
    """The ``links`` (u, v) whose ``shingles`` (node, shingles) have a Jaccard similarity of ALIKE or more.

    The shingles of a node with many links are repeated, and its links dealt among the copies.
    """
    ends = links.select(F.explode(F.array("u", "v")).alias("node"))
    bound = max(per_task, -(-2 * links.count() // HOT_KEYS))
    hubs = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bound)
    hubs = F.broadcast(settle(hubs.select("node", F.expr(f"n div {per_task} + 1").alias("copies")), "hubs"))
    known = shingles.join(hubs, "node", "left").select(
        "node", "shingles", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1).cast("long")) - 1)).alias("copy")
    )

    def to(rows: DataFrame, end: str, other: str, name: str) -> DataFrame:
        told = rows.join(hubs.withColumnRenamed("node", end), end, "left")
        told = told.withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1).cast("long")))).drop("copies")
        return told.join(known.withColumnsRenamed({"node": end, "shingles": name}), [end, "copy"]).drop("copy")

    both = F.size(F.array_intersect("a", "b"))
    alike = F.expr(f"100 * both >= {round(100 * ALIKE)} * (size(a) + size(b) - both)")
    return to(to(links, "u", "v", "a"), "v", "u", "b").withColumn("both", both).where(alike).select("u", "v")


def _keyed(df: DataFrame, keys: list[str], doc_id: Column, mark: Column) -> DataFrame:
    """``df`` with ``keys`` of a row without nulls, so that a null doc_id is one like others."""
    blank = F.lit("" if dict(df.select(doc_id.alias("x")).dtypes)["x"] == "string" else 0)
    return df.withColumns(dict(zip(keys, (F.coalesce(doc_id, blank), doc_id.isNull(), mark))))


def _survivors(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The ``keys`` of the row that stays of every group, and n, how many rows have them."""
    marked = settle(_wide_fingerprints(docs), "wide-fingerprints")
    rows = marked.count()
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "mark")
    nodes = marked.groupBy("fp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = settle(nodes.withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    found = settle(_candidates(nodes, nodes.count()), "candidates")
    crowds, links = found.where("layer < 0").select(F.col("u").alias("node"), F.col("v").alias("label")), found.where("layer >= 0")
    asked = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    asked = settle(nodes.join(asked, "node", "left_semi").select("fp", "node", "n"), "asked")
    shingles = join_hot(marked.select("fp", "shingles"), asked, ["fp"], "n", rows).groupBy("node").agg(F.min("shingles").alias("shingles"))
    shingles = settle(shingles, "shingles")
    sure = settle(_alike(links.where("layer = 0").select("u", "v"), shingles), "alike")
    roots = settle(components(sure), "roots")
    # where a link of the first forest fell, the next ones may still join what it would have joined
    one, two = (roots.select(F.col("u").alias(end), F.col("root").alias(f"{end}_root")) for end in ("u", "v"))
    more = links.where("layer > 0").join(one, "u", "left").join(two, "v", "left")
    more = settle(more.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v"), "still-apart")
    if not more.isEmpty():
        sure = settle(sure.union(_alike(more, shingles)), "alike-more")
        roots = settle(components(sure), "roots-more")
    # what the forests left out
    rest = settle(_crowd_links(crowds, roots, shingles), "crowd-links")
    if not rest.isEmpty():
        roots = components(sure.union(rest))
    roots = roots.withColumnRenamed("u", "node")
    chosen = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("first").alias("first"))
    often = _keyed(marked, keys, F.col("doc_id"), F.col("mark")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _keyed(chosen, keys, F.col("first.doc_id"), F.col("first.mark")).join(often, keys).select(*keys, "n")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of every group of near-duplicates, with its own columns.

    Two texts are linked if their sets of five-word shingles (fewer words: all of them; A-Z
    lower-cased) have a Jaccard similarity of 0.8 or more, as far as the tables meet them (see the
    module's text); texts without words are linked with one another. Groups are what links reach.
    The row of the smallest doc_id stays, one without doc_id only where no row of the group has one;
    of several rows of that doc_id, one. Texts are read whole; one has to fit into a task. An empty
    table gives no rows.
    """
    known, none, mark = (fresh(x, docs.columns) for x in ("_known", "_none", "_mark"))
    keys = [known, none, mark]
    chosen = settled(docs.sparkSession, lambda: _survivors(docs, keys), "kept-first")
    own = _keyed(docs, keys, docs["doc_id"], F.xxhash64(docs["text"]))
    once = own.join(chosen.where("n = 1"), keys, "left_semi").drop(*keys)
    often = chosen.where("n > 1")
    if often.isEmpty():
        return once
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = chosen.agg(F.sum("n")).first()[0]
    again = join_hot(own, often, keys, "n", rows).groupBy(*keys).agg(F.min_by(row, F.xxhash64(row)).alias("row")).select("row.*")
    return once.unionByName(again)
