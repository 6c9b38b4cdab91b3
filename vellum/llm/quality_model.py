"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown on a bounded sample of labelled documents, on features cut into histogram bins,
and flattened into arrays of a perfect binary tree each. Every document is then scored inside Spark's
tasks by walking all trees at once, one level at a time, with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = (
    "log_bytes", "log_words", "mean_word", "long_word", "distinct_words", "top_word", "repeated_pairs", "lines_per_word",
    "repeated_lines", "upper", "lower", "digits", "space", "wide", "marks", "symbols", "pipes", "shouts", "stops", "entropy",
)

_CODE = np.arange(256)
_UPPER = (_CODE >= 65) & (_CODE <= 90)
_LOWER = (_CODE >= 97) & (_CODE <= 122)
_DIGIT = (_CODE >= 48) & (_CODE <= 57)
_SPACE = (_CODE == 32) | ((_CODE >= 9) & (_CODE <= 13))
_WIDE = _CODE >= 128
_MARK = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _WIDE)
_SYMBOL = np.isin(_CODE, list(b"#*$%&<>"))


def statistics(text: bytes) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    size = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256).astype(float)
    words = text.split()
    n = len(words)
    share = counts / max(1, size)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    present = share[share > 0]
    return [
        np.log1p(size),
        np.log1p(n),
        sum(map(len, words)) / max(1, n),
        max(map(len, words), default=0),
        len(seen) / max(1, n),
        max(seen.values(), default=0) / max(1, n),
        1 - len(pairs) / max(1, n - 1),
        len(lines) / max(1, n),
        1 - len(set(lines)) / max(1, len(lines)),
        share[_UPPER].sum(),
        share[_LOWER].sum(),
        share[_DIGIT].sum(),
        share[_SPACE].sum(),
        share[_WIDE].sum(),
        share[_MARK].sum(),
        share[_SYMBOL].sum(),
        share[ord("|")],
        share[ord("!")],
        share[ord(".")] + share[ord(",")],
        float(-(present * np.log2(present)).sum()),
    ]


@dataclass
class Trees:
    """Perfect binary trees of one depth; children of node i are 2i+1 and 2i+2, leaves come last."""

    base: float
    depth: int
    feature: np.ndarray  # [tree, inner node]
    threshold: np.ndarray  # [tree, inner node]; a greater value goes to the second child
    value: np.ndarray  # [tree, leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.value))[None]
        at = np.zeros((len(x), len(self.value)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return self.base + self.value[trees, at - (2**self.depth - 1)].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Grow the trees on features ``x`` and labels ``y`` (0 or 1); without rows every score is a half."""
    inner, leaves = 2**depth - 1, 2**depth
    n, width = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    out = Trees(base, depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if not n:
        return out
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = p - y, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(count)
            feature, cut = np.zeros(count, np.int64), np.full(count, bins)
            for f in range(width):
                key = local * bins + binned[:, f]
                shape = (count, bins)
                g = np.bincount(key, gradient, count * bins).reshape(shape).cumsum(1)
                h = np.bincount(key, hessian, count * bins).reshape(shape).cumsum(1)
                c = np.bincount(key, minlength=count * bins).reshape(shape).cumsum(1)
                total_g, total_h, total_c = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = g**2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g**2 / (total_h + ridge)
                gain[(c < least) | (total_c - c < least)] = 0
                top = gain.argmax(1)
                own = gain[np.arange(count), top]
                better = own > best + 1e-12
                best[better], feature[better], cut[better] = own[better], f, top[better]
            split = cut < bins
            for k in np.flatnonzero(split):
                out.feature[t, first + k] = feature[k]
                out.threshold[t, first + k] = cuts[feature[k]][cut[k]] if cut[k] < len(cuts[feature[k]]) else np.inf
            right = split[local] & (binned[np.arange(n), feature[local]] > cut[local])
            at = 2 * at + 1 + right
        leaf = at - inner
        value = -rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, hessian, leaves) + ridge)
        out.value[t] = value
        margin += value[leaf]
    return out


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 on division by 4."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Trees:
    """Trees from at most ``most`` labelled documents that aren't held out, those first by a hash of their id.

    A doc_id with several labels has its highest, one with several texts the least of them, so no more
    than ``most`` rows come to the driver; labels without doc_id or quality are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or b"") for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], names=["doc_id", "quality", "x"])

    kinds = dict(rows.dtypes)
    found = rows.mapInArrow(features, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, x array<double>").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = (found.column("quality").to_numpy().astype(float) >= 1).astype(float)
    order = np.lexsort((*x.T, found.column("doc_id").to_numpy()))
    return boost(x[order], y[order])


def scored(docs: DataFrame, model: Trees, text: str = "text") -> Column:
    """The score (0 to 1) of the ``text`` column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            x = np.array([statistics(t or b"") for t in column.to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.array(shared.value.score(x))

    return run(F.col(text).cast("binary"))


def judge(docs: DataFrame, labels: DataFrame, at_least: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= ``at_least``) of every row.

    A null text is scored as an empty one. Rows are kept one for one, repeated ones and null doc_ids
    too (which are never labelled). Without any label every score is a half. Texts are read whole; one
    has to fit into a task. Of ``docs`` only doc_id and text are read, of ``labels`` doc_id and quality.
    """
    docs = docs.select("doc_id", "text")
    model = learn(docs, labels.select("doc_id", "quality"))
    rows = docs.select("doc_id", held_out().alias("held_out"), scored(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= at_least).cast("int"))
