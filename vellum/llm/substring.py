"""Substring dedup by difference-cover anchors.

A window of 13 words that also starts in a document of smaller doc_id is to be removed. Hashing every
window of the corpus against every other is costly, so windows are first filtered by anchors: 7-word
runs, hashed only where their place modulo 7 lies in the difference cover {0, 1, 3}. For any two places
there is a shift below 7 that puts both on the cover, so two equal windows share an aligned anchor
inside. Only windows around an anchor that two parts share are extended to 13 words and compared.

The unit of exchange is a part: some 8 MB of text, chosen by a hash of the row. A part says each of its
hashes once, however many of its documents have it, to a bucket chosen by the hash, and gets one
answer; documents of the same part are compared inside it. So a passage that a third of all documents
hold costs one message a part, not one a document, and no pairs are made. Parts and buckets grow with
the corpus: parts without bound, in at most FILES files, and buckets up to BUCKETS.

Anchors only choose candidates and have 64 bits. Windows are told apart by 96: two words that a corpus
of 10^14 bytes doesn't expect to share by chance.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import parts, settle, shared_path

WINDOW, PERIOD = 13, 7
#: Fixed value: a perfect difference cover modulo 7.
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
MEMORY = 200_000
#: Most files that hold the dealt texts, and most buckets of hashes.
FILES, BUCKETS = 20_000, 1 << 17
#: What the hashes of an anchor, and the two of a window, multiply by.
STEP, CHECK = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A window as it is sent: its hash and a check of 32 bits.
KEY = np.dtype([("hash", "<u8"), ("check", "<u4")])
SPANS = re.compile(rb"[^\x20\x09-\x0D]+")


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMORY:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def runs(hashes: np.ndarray, length: int, step: np.uint64 = STEP) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` words, by the place where it starts."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out *= step
        out += hashes[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def windows_of(hashes: np.ndarray) -> np.ndarray:
    """The KEY of every window."""
    out = np.empty(max(0, len(hashes) - WINDOW + 1), KEY)
    out["hash"] = runs(hashes, WINDOW)
    out["check"] = runs(hashes, WINDOW, CHECK) >> np.uint64(32)
    return out


def grouped(keys: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): places sorted by key, then rank, and which of them begin another key."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, bool)
    hashes = np.ascontiguousarray(keys["hash"]) if keys.dtype == KEY else keys
    order = np.lexsort((rank, hashes))
    ranked = hashes[order]
    new = ranked[1:] != ranked[:-1]
    if keys.dtype == KEY:
        check = keys["check"][order]
        other = check[1:] != check[:-1]
        if (other & ~new).any():  # keys that share a hash by chance
            order = np.lexsort((rank, keys["check"], hashes))
            ranked, check = hashes[order], keys["check"][order]
            new, other = ranked[1:] != ranked[:-1], check[1:] != check[:-1]
        new |= other
    return order, np.concatenate([[True], new])


def on_cover(n: int) -> np.ndarray:
    """The places below n that lie on the cover."""
    place = np.arange(n)
    return place[np.isin(place % PERIOD, COVER)]


def held(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known``, which is sorted (KEYs: by hash, then check)."""
    if not len(known):
        return np.zeros(len(values), bool)
    if known.dtype != KEY:
        return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
    at = np.searchsorted(known["hash"], values["hash"])
    out = np.zeros(len(values), bool)
    left = np.flatnonzero(at < len(known))
    while len(left):  # as often as keys share a hash: once, but for chance
        same = known["hash"][at[left]] == values["hash"][left]
        left = left[same]
        out[left] |= known["check"][at[left]] == values["check"][left]
        at[left] += 1
        left = left[~out[left] & (at[left] < len(known))]
    return out


def around(anchored: np.ndarray, windows: int) -> np.ndarray:
    """Which of ``windows`` windows hold one of the ``anchored`` places' anchors whole."""
    change = np.zeros(windows + 1, np.int64)
    np.add.at(change, np.clip(anchored - (PERIOD - 1), 0, windows), 1)
    np.add.at(change, np.clip(anchored + 1, 0, windows), -1)
    return np.cumsum(change[:-1]) > 0


def removed(flagged: np.ndarray, words: int) -> np.ndarray:
    """Which words the ``flagged`` windows cover."""
    change = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(flagged)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _rows(table: pa.Table) -> tuple[list, list[bytes]]:
    return table.column("doc_id").to_pylist(), [t or b"" for t in table.column("text").to_pylist()]


def _messages(part: int, buckets: int, keys: np.ndarray, firsts: np.ndarray | None) -> pa.Table:
    """One row per bucket that any of the distinct ``keys`` belongs to."""
    hashes = keys["hash"] if keys.dtype == KEY else keys
    bucket = ((hashes >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, bucket = keys[order], bucket[order]
    firsts = None if firsts is None else firsts[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(bucket)]]).astype(np.int64)
    return pa.table(
        {
            "part": pa.array(np.full(len(starts), part, np.int64)),
            "bucket": pa.array(bucket[starts]),
            "hashes": pa.array([keys[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
            "firsts": pa.array([b"" if firsts is None else firsts[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
        }
    )


MESSAGE = "part long, bucket long, hashes binary, firsts binary"


def _anchors(buckets: int):
    """A part's distinct anchors."""

    def run(table: pa.Table) -> pa.Table:
        known, found = WordHashes(), []
        for doc_id, text in zip(*_rows(table)):
            words = text.split()
            if doc_id is not None and len(words) >= WINDOW:
                own = runs(known.of(words), ANCHOR)
                found.append(own[on_cover(len(own))])
        hashes = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        return _messages(table.column("part")[0].as_py(), buckets, hashes, None)

    return run


def _candidates(buckets: int):
    """A part's distinct windows around shared anchors, each with the smallest doc_id that has it."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        none = _messages(0, buckets, np.empty(0, KEY), np.empty(0, np.int64))
        if not texts.num_rows or not answers.num_rows:
            return none
        shared, known = _pooled(answers, np.uint64), WordHashes()
        keys, ids = [], []
        for doc_id, text in zip(*_rows(texts)):
            words = text.split()
            if doc_id is None or len(words) < WINDOW:
                continue
            own = known.of(words)
            anchors = runs(own, ANCHOR)
            place = on_cover(len(anchors))
            place = place[held(anchors[place], shared)]
            if len(place):
                windows = windows_of(own)
                windows = windows[around(place, len(windows))]
                keys.append(windows)
                ids.append(np.full(len(windows), doc_id, np.int64))
        if not keys:
            return none
        flat, owner = np.concatenate(keys), np.concatenate(ids)
        order, first = grouped(flat, owner)
        return _messages(texts.column("part")[0].as_py(), buckets, flat[order[first]], owner[order[first]])

    return run


def _pooled(answers: pa.Table, kind: np.dtype) -> np.ndarray:
    blobs = [b for b in answers.column("hashes").to_pylist() if b]
    keys = np.frombuffer(b"".join(blobs), kind)
    return keys[grouped(keys, np.zeros(len(keys), np.int8))[0]]


def _answer(windows: bool):
    """To each part, which of its hashes other parts have (for windows: with a smaller doc_id)."""
    kind = KEY if windows else np.dtype(np.uint64)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(pdf["hashes"]), kind)
        owner = np.repeat(pdf["part"].to_numpy(), pdf["hashes"].map(len).to_numpy() // kind.itemsize)
        rank = np.frombuffer(b"".join(pdf["firsts"]), np.int64) if windows else owner
        order, new = grouped(keys, rank)
        keys, owner, rank = keys[order], owner[order], rank[order]
        group = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        if windows:
            told = rank > rank[starts][group]
        else:
            told = (np.diff(np.concatenate([starts, [len(keys)]])) > 1)[group]
        keys, owner = keys[told], owner[told]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        to, at = np.unique(owner, return_index=True)
        ends = [*at[1:], len(owner)]
        return pd.DataFrame({"part": to.astype(np.int64), "hashes": [keys[s:e].tobytes() for s, e in zip(at, ends)]})

    return run


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """``text`` without the words to remove and the white space after each of them."""
    spans = [m.span() for m in SPANS.finditer(text)]
    ends = [s for s, _ in spans[1:]] + [len(text)]
    return b"".join(text[s:e] for (s, _), e, g in zip(spans, ends, gone.tolist()) if not g)


def _clean(texts: pa.Table, answers: pa.Table, whole: bool) -> pa.Table:
    """Every text without the words to remove: the words joined by one space, or ``whole`` with its own white space."""
    told, known = _pooled(answers, KEY) if answers.num_rows else np.empty(0, KEY), WordHashes()
    ids, blobs = _rows(texts)
    flat, owner, sizes = [], [], []
    for doc_id, text in zip(ids, blobs):
        own = windows_of(known.of(text.split())) if doc_id is not None else np.empty(0, KEY)
        flat.append(own)
        owner.append(np.full(len(own), doc_id or 0, np.int64))
        sizes.append(len(own))
    keys, owners = np.concatenate(flat or [np.empty(0, KEY)]), np.concatenate(owner or [np.empty(0, np.int64)])
    order, new = grouped(keys, owners)
    least = owners[order]
    later = np.zeros(len(keys), bool)
    later[order] = least > least[np.flatnonzero(new)][np.cumsum(new) - 1]
    later |= held(keys, told)
    n_words, n_removed, kept = [], [], []
    at = 0
    for text, size in zip(blobs, sizes):
        words = text.split()
        flags = later[at : at + size]
        at += size
        gone = removed(flags, len(words)) if flags.any() else None
        n_words.append(len(words))
        n_removed.append(0 if gone is None else int(gone.sum()))
        if whole:
            kept.append(text if gone is None else cut(text, gone))
        else:
            kept.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]))
    return pa.table(
        {
            "row": texts.column("row"),
            "doc_id": pa.array(ids, pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def _joined(texts: pa.Table, answers: pa.Table) -> pa.Table:
    return _clean(texts, answers, whole=False)


def _whole(texts: pa.Table, answers: pa.Table) -> pa.Table:
    return _clean(texts, answers, whole=True)


def _by_part(texts: DataFrame, n: int) -> DataFrame:
    """``texts`` written in buckets by part, so that the steps read them without dealing them out again.

    The table's entry in the catalog goes as soon as it has been read; its files stay.
    """
    spark = texts.sparkSession
    name, path = f"texts_{uuid.uuid4().hex}", shared_path(spark, "texts")
    files = min(FILES, max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = texts.repartition(files, "part").write.bucketBy(files, "part")
    dealt.option("path", path).option("compression", "zstd").saveAsTable(name)
    written = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return written


def _parts(docs: DataFrame, part_bytes: int, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """The texts by part, and the windows told to each part."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = parts(spark, size, part_bytes)
    buckets = min(n, BUCKETS)
    # rows of one doc_id, or of none, may lie in different parts: they don't remove each other's words
    texts = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.lit(None).cast("boolean")).alias("row"),
    )
    texts = _by_part(texts, n)
    by_part = texts.select("part", "doc_id", "text").groupBy("part")
    answer = "part long, hashes binary"
    shared = by_part.applyInArrow(_anchors(buckets), MESSAGE).groupBy("bucket").applyInPandas(_answer(False), answer)
    candidates = by_part.cogroup(shared.groupBy("part")).applyInArrow(_candidates(buckets), MESSAGE)
    return texts, settle(candidates.groupBy("bucket").applyInPandas(_answer(True), answer), "repeated-windows")


def remove_repeats(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row.

    Words are maximal runs without ASCII white space, unchanged. Each word is removed that a window
    of 13 words covers whose word sequence also starts in a document of smaller doc_id; windows are
    judged on the input. Equality is judged by 96 bits of hashes of the window. A null text has no
    words. A row without doc_id is no one's predecessor and keeps all words; rows of one doc_id don't
    remove each other's words. Texts of under 13 words stay whole; a very long text is a part of its
    own and has to fit into a task. An empty table gives no rows. Other columns are not read.
    """
    texts, told = _parts(docs, part_bytes, [])
    by_part = texts.groupBy("part").cogroup(told.groupBy("part"))
    return by_part.applyInArrow(_joined, "row boolean, doc_id long, n_words long, n_removed long, kept string").drop("row")


def digests(cleaned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words that stay."""
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, part_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with the repeated words cut out of their texts; all other columns stay as they were.

    A text that loses nothing stays byte for byte; what is left of another keeps its own white space.
    A document that loses all its words goes. ``n_chars``, where there is one, is counted anew for
    texts that changed. Nulls, ties and repeated rows are treated as by ``remove_repeats``.
    """
    carried = [c for c in docs.columns if c != "text"]
    texts, told = _parts(docs, part_bytes, carried)
    kind = texts.schema["row"].dataType.simpleString()

    done = texts.groupBy("part").cogroup(told.groupBy("part"))
    done = done.applyInArrow(_whole, f"row {kind}, doc_id long, n_words long, n_removed long, kept string")
    done = done.where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    own = {c: F.col(f"row.`{c}`") for c in carried} | {"text": F.col("kept")}
    if "n_chars" in own:
        counted = F.length("kept").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(changed, counted).otherwise(F.col("row.n_chars"))
    return done.select(*[own[c].alias(c) for c in docs.columns])
