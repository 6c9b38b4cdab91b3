"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word is the sum over all ways to cut it into pieces, found by a forward pass over its lattice; words
are independent, so a text's log-likelihood is the sum over its words. Probabilities are learned by
expectation-maximisation over the corpus's own word counts, which grow with the corpus and stay
distributed; only the tables of vocabulary x languages numbers pass through the driver.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import fresh, settle

LETTERS = re.compile(r"[^\W\d_]+")
#: Words of up to so many characters (with the mark) are summed as plain products, longer ones in logarithms.
PLAIN = 17
#: The least probability of a piece that is known: products of PLAIN of them don't underflow.
FLOOR = 1e-14
#: Most cells of a lattice that are held at once.
CELLS = 6_000_000
#: Languages of one model, whose table is broadcast; more languages make several models, one after the other.
GROUP = 256
#: Texts whose words are scored together.
BATCH = 1024
#: Runs of text that are looked up together, and that a process remembers before it starts anew.
PART = 100_000
MEMORY = 500_000
#: Fixed value: the mark that stands before a word in the vocabulary.
MARK = "▁"


def words_of(chunk: str) -> list[str]:
    """The letter runs of lower-case text, each with the word mark."""
    if chunk.isalpha():
        return [MARK + chunk]
    return [MARK + w for w in LETTERS.findall(chunk)]


def vocabulary_pieces(model_file: str) -> list[str]:
    """The vocabulary's pieces that are letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    named = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return sorted({p for p in named if LETTERS.fullmatch(p.removeprefix(MARK) or "a") and p == p.lower()} | {MARK})


class Lattice:
    """All pieces of words, as ids by (end, length); the id after the last piece is an unknown letter.

    Pieces are found by a rolling hash of their letters in an open-addressed table, for all words of
    one length at once.
    """

    BITS = 19
    STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.found = np.full(1 << self.BITS, -1, np.int32)
        self.probes = 1
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            if own:
                *_, last = self._hashes([pieces[i] for i in own], n)
                for i, key in zip(own, last[:, 0].tolist()):
                    at, tries = int(self._slot(np.array([key], np.uint64))[0]), 1
                    while self.found[at] >= 0:
                        at, tries = (at + 1) % len(self.keys), tries + 1
                    self.keys[at], self.found[at] = key, i
                    self.probes = max(self.probes, tries)

    def _slot(self, key):
        return (key * self.SPREAD) >> np.uint64(64 - self.BITS)

    def _hashes(self, words: list[str], most: int) -> Iterator[np.ndarray]:
        """For each length up to ``most``, the hash of every substring [word, start]."""
        codes = np.array(words).view(np.uint32).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        rolled = np.zeros_like(codes)
        with np.errstate(over="ignore"):
            for n in range(1, most + 1):
                places = codes.shape[1] - n + 1
                rolled = (rolled[:, :places] * self.STEP + codes[:, n - 1 :]) ^ np.uint64(n)
                yield rolled

    def _ids(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int32)
        with np.errstate(over="ignore"):
            at = self._slot(keys).astype(np.int64)
        for _ in range(self.probes):
            hit = self.keys[at] == keys
            out[hit] = self.found[at[hit]]
            at = (at + 1) & ((1 << self.BITS) - 1)
        return out

    def segment(self, words: list[str], start: int, stop: int) -> np.ndarray:
        """ids [word, end, length] of the pieces that end behind ``start``, up to ``stop``, in words of one length; -1: no such piece."""
        most = min(stop, self.longest)
        low = max(0, start - most + 1)
        grid = np.full((len(words), stop - start, most + 1), -1, np.int32)
        for n, keys in enumerate(self._hashes([w[low:stop] for w in words], min(most, stop - low)), 1):
            end = max(start + 1, low + n)
            grid[:, end - start - 1 :, n] = self._ids(keys[:, end - n - low :])
        single = grid[:, :, 1]
        single[single < 0] = self.unknown
        return grid

    def segments(self, words: list[str], backwards: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(start, ids) over long words of one length, a bounded piece of them at a time."""
        size, step = len(words[0]), max(1, CELLS // (len(words) * (self.longest + 1)))
        starts = range(0, size, step)
        for start in reversed(starts) if backwards else starts:
            yield start, self.segment(words, start, min(size, start + step))

    def by_length(self, words: list[str], block: int = 20_000) -> Iterator[tuple[list[int], np.ndarray | None]]:
        """(places of words of one length, ids [word, end, length]); instead of ids None for words of over PLAIN characters."""
        places: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            places[len(w)].append(i)
        for n, every in places.items():
            own = block if n <= PLAIN else max(1, min(block, CELLS // (16 * n)))
            for at in range(0, len(every), own):
                part = every[at : at + own]
                if n > PLAIN:
                    yield part, None
                    continue
                grid = self.segment([words[i] for i in part], 0, n)
                yield part, np.concatenate([np.full_like(grid[:, :1], -1), grid], 1)


def forward(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """alpha [end, word, language]: the summed probability of all segmentations up to each end."""
    words, ends, most = grid.shape
    alpha = np.zeros((ends, words, table.shape[1]))
    alpha[0] = 1
    for e in range(1, ends):
        for n in range(1, min(e, most - 1) + 1):
            at = grid[:, e, n]
            if (at >= 0).any():
                alpha[e] += alpha[e - n] * table[at]
    return alpha


def expected(grid: np.ndarray, table: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words seen ``counts`` times; ``table`` is of one language."""
    words, ends, most = grid.shape
    alpha = forward(grid, table)[:, :, 0]
    flat = table[:, 0]
    beta = np.zeros((ends, words))
    beta[-1] = 1
    for e in range(ends - 1, 0, -1):
        for n in range(1, min(e, most - 1) + 1):
            beta[e - n] += beta[e] * flat[grid[:, e, n]]
    weight = counts / alpha[-1]
    used, uses = [], []
    for e in range(1, ends):
        for n in range(1, min(e, most - 1) + 1):
            at = grid[:, e, n]
            here = np.flatnonzero(at >= 0)
            at = at[here]
            used.append(at)
            uses.append((alpha[e - n] * beta[e] * weight)[here] * flat[at])
    return np.bincount(np.concatenate(used), np.concatenate(uses), len(flat))


def long_forward(segments: Iterator[tuple[int, np.ndarray]], logs: np.ndarray) -> Iterator[np.ndarray]:
    """For each end in turn, the logarithm of the summed probability of all segmentations up to it [word, language].

    ``logs`` is the table's logarithm. The last sums are kept only as far back as a piece reaches.
    """
    ring: list[np.ndarray] = []
    for start, grid in segments:
        words, ends, width = grid.shape
        if not ring:
            ring = [np.zeros((words, logs.shape[1]))]
        for k in range(ends):
            most = min(start + k + 1, width - 1)
            each = np.stack(ring[:most], 1) + logs[grid[:, k, 1 : most + 1]]
            top = each.max(1, keepdims=True)
            ring = [top[:, 0] + np.log(np.exp(each - top).sum(1)), *ring[: width - 1]]
            yield ring[0]


def long_expected(lattice: Lattice, words: list[str], logs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """As ``expected``, in logarithms, for words of one length; ``logs`` is of one language."""
    size = len(words[0])
    alpha = np.zeros((size + 1, len(words)))
    for e, sums in enumerate(long_forward(lattice.segments(words), logs), 1):
        alpha[e] = sums[:, 0]
    flat, out = logs[:, 0], np.zeros(len(logs))
    # what is gathered at an end from the pieces that begin there, until its turn comes
    beta = {size: np.zeros(len(words))}
    for start, grid in lattice.segments(words, backwards=True):
        for k in range(grid.shape[1] - 1, -1, -1):
            e = start + k + 1
            own = beta.pop(e)
            for n in range(1, min(e, grid.shape[2] - 1) + 1):
                at = grid[:, k, n]
                here = np.flatnonzero(at >= 0)
                if len(here):
                    step = np.full(len(words), -np.inf)
                    step[here] = own[here] + flat[at[here]]
                    beta[e - n] = np.logaddexp(beta[e - n], step) if e - n in beta else step
                    uses = counts[here] * np.exp(alpha[e - n, here] + step[here] - alpha[-1, here])
                    out += np.bincount(at[here], uses, len(out))
    return out


@dataclass
class LanguageModel:
    """languages and, for each piece, its probability in each; the last row (zero) is for no piece."""

    pieces: list[str]
    languages: list[str]
    table: np.ndarray
    _state: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"pieces": self.pieces, "languages": self.languages, "table": self.table, "_state": {}}

    def _add(self, chunks: list[str], start: int) -> None:
        """Score new chunks in rows from ``start``; a chunk's logarithm is the sum of its words'."""
        own = self._state
        rows, scores = own["rows"], own["scores"]
        rows.update(zip(chunks, range(start, start + len(chunks))))
        if not chunks:
            return
        found = [words_of(c) for c in chunks]
        words = list(dict.fromkeys(w for ws in found for w in ws))
        logs = np.zeros((len(words), len(self.languages)))
        for places, grid in own["lattice"].by_length(words):
            if grid is None:
                *_, logs[places] = long_forward(own["lattice"].segments([words[i] for i in places]), own["logs"])
            else:
                logs[places] = np.log(forward(grid, self.table)[-1])
        at = dict(zip(words, range(len(words))))
        flat = np.fromiter((at[w] for ws in found for w in ws), np.int64)
        owner = np.repeat(np.arange(start, start + len(chunks)), [len(ws) for ws in found])
        for k in range(logs.shape[1]):
            scores[start : start + len(chunks), k] = np.bincount(owner - start, logs[flat, k], len(chunks))

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """[text, language], natural logarithms."""
        own = self._state
        if not own:
            with np.errstate(divide="ignore"):
                logs = np.log(self.table)
            own |= {"lattice": Lattice(self.pieces), "logs": logs, "rows": {}, "scores": np.zeros((MEMORY + PART, len(self.languages)))}
        out = np.zeros((len(texts), len(self.languages)))
        owners: list[int] = []
        chunks: list[str] = []
        for i, text in enumerate(texts):
            chunks += text.lower().split()
            owners += [i] * (len(chunks) - len(owners))
            while len(chunks) >= PART or (chunks and i == len(texts) - 1):
                part, mine = chunks[: PART], np.array(owners[: PART])
                chunks, owners = chunks[PART :], owners[PART :]
                rows = own["rows"]
                new = set(part).difference(rows)
                if len(rows) + len(new) > MEMORY:
                    rows.clear()
                    new = set(part)
                self._add(list(new), len(rows))
                found = own["scores"][np.fromiter(map(rows.__getitem__, part), np.int64, len(part))]
                starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                out[mine[starts]] += np.add.reduceat(found, starts)
        return out

    def best(self, texts: list[str | None]) -> list[tuple[str, float, float] | None]:
        """The likeliest language of each text, its logarithm and the total over it; None where none can be told."""
        out: list[tuple[str, float, float] | None] = [None] * len(texts)
        told = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        for at in range(0, len(told), BATCH):
            part = told[at : at + BATCH]
            logs = self.log_likelihoods([texts[i] for i in part])
            first = logs.argmax(1)
            total = np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            for i, b, row, s in zip(part, first, logs, total):
                out[i] = (self.languages[b], float(row[b]), float(s))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The likeliest language of each text and its share of the total; ``und``, 0 where none can be told."""
        found = self.best(texts)
        return [b[0] if b else "und" for b in found], [1 / b[2] if b else 0.0 for b in found]


def held_out() -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5 (null: as an empty id)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts by language; runs without white space are counted before they are cut into words."""
    chunks: dict[str, Counter] = defaultdict(Counter)

    def flush():
        for lang, own in chunks.items():
            counts: Counter = Counter()
            for chunk, n in own.items():
                for w in words_of(chunk):
                    counts[w] += n
            words = list(counts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                n = pa.array([counts[w] for w in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), n], names=["lang", "word", "n"])
        chunks.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunks[lang].update(text.lower().split())
            if sum(map(len, chunks.values())) > MEMORY:
                yield from flush()
    yield from flush()


def learn(docs: DataFrame, model_file: str, rounds: int = 2, smooth: float = 0.01) -> list[LanguageModel]:
    """Learn from text and lang of all documents that aren't held out; rows with a null in either are left out.

    A model for each GROUP of languages, by name: what a language's pieces are like depends on its own
    words alone. One model without languages where there is nothing to learn from.
    """
    pieces = vocabulary_pieces(model_file)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("lang", "text")
    words = settle(
        rows.mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words"
    )
    # of the languages, the names pass the driver
    every = [r[0] for r in words.select("lang").distinct().orderBy("lang").collect()]
    groups = [every[at : at + GROUP] for at in range(0, len(every), GROUP)] or [[]]
    own = lambda g: words if len(groups) == 1 else words.where(F.col("lang").between(g[0], g[-1]))
    return [_learned(own(g), g, pieces, rounds, smooth) for g in groups]


def _learned(words: DataFrame, languages: list[str], pieces: list[str], rounds: int, smooth: float) -> LanguageModel:
    size = len(pieces) + 2  # an unknown letter, and no piece
    table = np.full((size, max(1, len(languages))), 1 / size)
    table[-1] = 0
    spark = words.sparkSession
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast((pieces, languages, table))

        def uses(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, langs, probs = shared.value
            lattice, total = Lattice(names), np.zeros(probs.shape).T
            with np.errstate(divide="ignore"):
                logs = np.log(probs)
            held: list[pd.DataFrame] = []
            for frame in chain(frames, [None]):
                if frame is not None:
                    held.append(frame)
                # many words together make long columns for numpy
                if held and (frame is None or sum(map(len, held)) >= PART):
                    for lang, own in pd.concat(held).groupby("lang"):
                        k = langs.index(lang)
                        counts, found = own["n"].to_numpy(float), own["word"].tolist()
                        for places, grid in lattice.by_length(found):
                            if grid is None:
                                total[k] += long_expected(lattice, [found[i] for i in places], logs[:, k : k + 1], counts[places])
                            else:
                                total[k] += expected(grid, probs[:, k : k + 1], counts[places])
                    held = []
            for k in range(len(langs)):
                used = np.flatnonzero(total[k])
                yield pd.DataFrame({"k": np.full(len(used), k), "piece": used, "uses": total[k][used]})

        found = words.mapInPandas(uses, "k long, piece long, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toPandas()
        table = np.full(table.shape, smooth)
        np.add.at(table, (found["piece"].to_numpy(int), found["k"].to_numpy(int)), found["uses"].to_numpy(float))
        table[-2:] = 0
        table = np.maximum(table / table.sum(0), FLOOR)
        table[-2:] = [[1e-7], [0]]
    return LanguageModel(pieces, languages, table)


def predicted(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A column struct(lang_pred, score) for the ``text`` column of ``docs``, by one model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            names, scores = own.predict(column.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return run(F.col(text))


def _best(docs: DataFrame, model: LanguageModel, text: str) -> Column:
    """A column struct(lang, log, total) of one of several models, null where nothing can be told."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("lang string, log double, total double")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for column in columns:
            found = own.best(column.to_pylist())
            yield pa.array([b and dict(zip(("lang", "log", "total"), b)) for b in found], pa.struct([("lang", pa.string()), ("log", pa.float64()), ("total", pa.float64())]))

    return run(F.col(text))


def told(docs: DataFrame, models: list[LanguageModel], name: str) -> DataFrame:
    """``docs`` with a column ``name``, struct(lang_pred, score).

    Several models score one after the other, so no task holds more than one. The texts are written
    once for that; the best of all models is the best of their best ones, and totals add up.
    """
    if len(models) == 1:
        return docs.withColumn(name, predicted(docs, models[0]))
    row = fresh("_row", docs.columns)
    docs = settle(docs.withColumn(row, F.monotonically_increasing_id()), "lang-docs")
    found = None
    for model in models:
        own = settle(docs.select(row, _best(docs, model, "text").alias("b")).where("b IS NOT NULL").select(row, "b.*"), "lang-scores")
        found = own if found is None else found.unionByName(own)
    every = found.groupBy(row).agg(F.collect_list(F.struct("log", "lang", "total")).alias("g"))  # one of each model
    top = F.array_max(F.transform("g", lambda x: x["log"]))
    total = F.aggregate("g", F.lit(0.0), lambda a, x: a + F.exp(x["log"] - F.col("top")) * x["total"])
    first = F.array_min(F.transform(F.filter("g", lambda x: x["log"] == F.col("top")), lambda x: x["lang"]))
    best = every.withColumn("top", top).select(row, F.struct(first.alias("lang_pred"), (1 / total).alias("score")).alias(name))
    none = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.join(best, row, "left").drop(row).withColumn(name, F.coalesce(name, none))


def identify(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text.

    A text that is null or without a letter, or any text where nothing could be learned, is ``und``
    with score 0. Rows are kept one for one, repeated ones and null doc_ids too (such a row counts as
    held out). Ties go to the first language by name. Texts and words are read whole however long they
    are; one text has to fit into a task. Any number of languages is learned. Only doc_id, text and lang
    are read.
    """
    docs = docs.select("doc_id", "text", "lang")
    rows = told(docs.drop("lang"), learn(docs, model_file), "p")
    return rows.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model_file: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language can be told with a score of ``least`` or more; all columns stay as they were."""
    name = fresh("_told", docs.columns)
    rows = told(docs, learn(docs.select("doc_id", "text", "lang"), model_file), name)
    return rows.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= least)).drop(name)
