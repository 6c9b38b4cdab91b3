"""Mixing sources to target weights by Pfair scheduling.

Every source's bytes are cut into steps of an eighth of a block, and every slot of the mix takes one
step. Slots are given out earliest deadline first: with n of the ``len`` slots of a run, a source's step
k (from 1) is released at slot floor((k - 1) * len / n) of the run and due by slot ceil(k * len / n), which
keeps it within less than one step of its share at every slot.

So that runs can be scheduled apart, in parallel, what each source has had by the end of any run is told
without the runs before: the sources' weights are halved again and again (``Shares``), and at each split
the slots so far are divided by the exact weights and rounded once. That is at most two steps off the
exact target at any slot number, however large, as at every split no side weighs more than three
quarters unless it is one source. Between the ends of a run the deadlines keep the same bound, so a
source is at most three steps off, and documents are whole: one stands at the step in which its middle
lies, which is half of a document off at most. Together that is less than a block, a block being
``block_bytes`` or the longest document, whichever is longer.

A source that runs out leaves, and the others start anew with their weights scaled up: a new phase. A
mix of a target size is asked for by ``least_weight``: it ends when the sources that are left hold less
than that part of the target weight.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import fresh, settle

#: Steps in a block, and runs that a task schedules at a time.
STEPS, TOGETHER = 8, 32


def interleave(weights: dict[str, int]) -> Iterator[tuple[str, int, int, int]]:
    """For slot 0, 1, ...: (source, step, release, deadline), earliest deadline first; steps count from 0.

    ``weights`` are positive integers, a source's share being its part of their total. Ties of
    deadlines go to the first source by name.
    """
    total = sum(weights.values())
    waiting = [(0, s, 1) for s in sorted(weights)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    now = 0
    while True:
        while waiting and waiting[0][0] <= now:
            release, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * total // weights[s]), s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        heapq.heappush(waiting, (j * total // weights[s], s, j + 1))
        yield s, j - 1, release, deadline
        now += 1


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of ``weights``, any numbers of which only positive ones count."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    unit = lcm(*(f.denominator for f in exact.values()))
    return {s: int(f * unit) for s, f in exact.items()}


class Shares:
    """How many of the first n slots belong to each of some integer weights, for any n, in whole numbers.

    Sources stand in order of weight, and their range is split where its weight is nearest to a half,
    again and again. Each split gives its first side the rounded share of the slots that the range has:
    both sides only grow with n, and their sum is exact.
    """

    def __init__(self, weights: dict[str, int]) -> None:
        self.names = sorted(weights, key=lambda s: (-weights[s], s))
        ends = [0]
        for s in self.names:
            ends.append(ends[-1] + weights[s])
        ranges, self.cuts, self.above, self.leaf = [(0, len(self.names))], [], [(-1, True)], {}
        for k, (lo, hi) in enumerate(ranges):  # grows on the way
            if hi - lo == 1:
                self.cuts.append(None)
                self.leaf[self.names[lo]] = k
                continue
            middle = ends[lo] + ends[hi]
            cut = min(max(bisect_left(ends, middle / 2, lo + 1, hi - 1), lo + 1), hi - 1)
            if cut > lo + 1 and middle - 2 * ends[cut - 1] < 2 * ends[cut] - middle:
                cut -= 1
            self.cuts.append((ends[cut] - ends[lo], ends[hi] - ends[lo], len(ranges)))
            ranges += [(lo, cut), (cut, hi)]
            self.above += [(k, True), (k, False)]

    def at(self, n: int) -> dict[str, int]:
        """Every source's steps among the first n slots."""
        given = [n] + [0] * (len(self.cuts) - 1)
        for k, cut in enumerate(self.cuts):
            if cut:
                own, total, child = cut
                given[child] = (2 * given[k] * own + total) // (2 * total)
                given[child + 1] = given[k] - given[child]
        return {s: given[k] for s, k in self.leaf.items()}

    def of(self, source: str, n: int) -> int:
        """One source's steps among the first n slots."""
        path, k = [], self.leaf[source]
        while k:
            k, first = self.above[k]
            path.append((*self.cuts[k][:2], first))
        for own, total, first in reversed(path):
            part = (2 * n * own + total) // (2 * total)
            n = part if first else n - part
        return n

    def reaches(self, source: str, steps: int, weights: dict[str, int], total: int) -> int:
        """The least n at which ``source`` has had ``steps`` steps."""
        low, high = max(0, (steps - 4) * total // weights[source]), (steps + 4) * total // weights[source] + 1
        while low < high:
            middle = (low + high) // 2
            if self.of(source, middle) >= steps:
                high = middle
            else:
                low = middle + 1
        return low


def plan(steps: dict[str, int], weights: dict[str, float], least_weight: float = 0.0) -> list[tuple]:
    """The phases: (source, phase, first, taken, start, length) for every source that a phase has.

    In the phase, of ``length`` slots from ``start``, the source gives ``taken`` steps from its
    ``first``. The work is a phase for every source, each over the sources that are left.
    """
    exact = whole_weights(weights)
    left = {s: n for s, n in steps.items() if n > 0 and s in exact}
    whole = sum(exact[s] for s in left)
    phases: list[tuple] = []
    start = phase = 0
    while left and Fraction(sum(exact[s] for s in left), whole) >= Fraction(least_weight):
        own = {s: exact[s] for s in left}
        total, shares = sum(own.values()), Shares(own)
        soonest = min((left[s] + 4) * total // own[s] + 1 for s in left)
        length = min(shares.reaches(s, left[s], own, total) for s in left if (left[s] - 4) * total // own[s] <= soonest)
        for s, taken in shares.at(length).items():
            phases.append((s, phase, steps[s] - left[s], taken, start, length))
            left[s] -= taken
        left = {s: n for s, n in left.items() if n}
        start += length
        phase += 1
    return phases


def run_of(shares: Shares, begin: int, end: int) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, step, release, deadline, slot) of slots ``begin`` to ``end`` of a phase, all counted in the phase."""
    before, after = shares.at(begin), shares.at(end)
    own = {s: after[s] - before[s] for s in after if after[s] > before[s]}
    for at, (s, k, release, deadline) in zip(range(begin, end), interleave(own)):
        yield s, before[s] + k, begin + release, begin + deadline, at


def schedule(steps: dict[str, int], weights: dict[str, float], least_weight: float = 0.0, period: int = 8192) -> list[tuple]:
    """The mix written out, for few steps: (source, step, release, deadline, slot) in order of the slot."""
    phases, exact, out = plan(steps, weights, least_weight), whole_weights(weights), []
    for phase in sorted({p[1] for p in phases}):
        own = {p[0]: p for p in phases if p[1] == phase}
        shares, (start, length) = Shares({s: exact[s] for s in own}), next(iter(own.values()))[4:]
        for begin in range(0, length, period):
            for s, k, *times in run_of(shares, begin, min(begin + period, length)):
                out.append((s, own[s][2] + k, *(start + t for t in times)))
    return out


PHASE = "source string, weight double, phase long, first long, taken long, start long, length long"
STEP = "source string, block long, release long, deadline long, slot long"


def _planned(least_weight: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = dict(zip(pdf["source"], pdf["steps"].astype(int)))
        weights = dict(zip(pdf["source"], pdf["weight"].astype(float)))
        rows = [(p[0], weights[p[0]], *p[1:]) for p in plan(steps, weights, least_weight)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in PHASE.split(", ")])

    return run


def _scheduled(period: int):
    """The steps of the runs of a task's part of a phase, from a row for each of the phase's sources."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shares = Shares(whole_weights(dict(zip(pdf["source"], pdf["weight"].astype(float)))))
        first = dict(zip(pdf["source"], pdf["first"].astype(int)))
        start, length, part = (int(pdf[c].iloc[0]) for c in ("start", "length", "part"))
        rows = []
        for begin in range(part * TOGETHER * period, min((part + 1) * TOGETHER * period, length), period):
            rows += [(s, first[s] + k, release, deadline, at) for s, k, release, deadline, at in run_of(shares, begin, min(begin + period, length))]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in STEP.split(", ")])
        for c in ("release", "deadline", "slot"):
            out[c] += np.int64(start)
        return out

    return run


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    smoothing: float = 0.8,
    block_bytes: int = 8192,
    period: int = 8192,
    least_weight: float = 0.0,
) -> DataFrame:
    """Where every document stands in the mix.

    ``weights`` gives each source's target weight (sources without one have none and stay out); their
    proportions are kept exactly. By default a source weighs its bytes to the power ``smoothing``, which
    lifts small sources and keeps a hot one from drowning the rest. ``period`` is the length of a run.

    Returns doc_id, source, bytes (of the text in UTF-8, plus one), block (the step at which it stands), release, deadline, slot and kept. By default every document of a source with a weight is
    kept; only where ``least_weight`` ends the mix, a document beyond its end has null release,
    deadline and slot and kept false, as has one of a source without weight. Nulls: a null source is a
    source of its own, named by an empty string together with empty names; a null text has no bytes. A
    text longer than a block stands whole at the step of its middle. Repeated rows are rows like
    others. An empty table gives no rows. Only doc_id, text and source are read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("bytes"),
        F.coalesce(F.crc32(F.col("text")), F.lit(0)).alias("check"),
    )
    # each source's rows in order, dealt in ranges that no hot source or repeated row can outgrow
    order = ["source", "doc_id", "bytes", "check", "own"]
    dealt = rows.withColumn("own", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = settle(dealt.withColumn("own", F.monotonically_increasing_id()), "mix-rows").withColumn("part", F.shiftrightunsigned("own", 33))
    step = max(1, block_bytes // STEPS)

    # a running sum of bytes over each source, in those pieces
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = settle(rows.groupBy("source", "part").agg(F.sum("bytes").alias("held")), "mix-pieces")
    totals = pieces.groupBy("source").agg(F.sum("held").alias("total"))
    starts = pieces.select("source", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "part").orderBy("own").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("run", F.coalesce(F.sum("bytes").over(within), F.lit(0)))
        .join(starts, ["source", "part"])
        .select("doc_id", "source", "bytes", F.expr(f"(start + run + bytes div 2) div {step}").alias("block"))
    )
    if weights is None:
        weight = F.pow(F.col("total").cast("double"), F.lit(smoothing))
    else:
        given = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        weight = F.coalesce(given[F.col("source")], F.lit(0.0)).cast("double")
    sources = totals.select("source", F.expr(f"(total + {step - 1}) div {step}").alias("steps"), weight.alias("weight"))
    # one row per source goes in; its phases come out
    planned = settle(sources.groupBy(F.lit(0).alias("all")).applyInPandas(_planned(least_weight), PHASE), "mix-plan")
    runs = planned.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {TOGETHER * period}"))))
    # a row for every step: far more than the optimizer expects of so small an input, hence the hint against a broadcast
    slots = runs.groupBy("phase", "part").applyInPandas(_scheduled(period), STEP)
    told = placed.join(slots.hint("merge"), ["source", "block"], "left")
    return told.select("doc_id", "source", "bytes", "block", "release", "deadline", "slot", F.col("slot").isNotNull().alias("kept"))


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are in the mix, in the order of their slots, with their own columns only.

    A doc_id that has rows in the mix keeps all its rows, at the first of their slots.
    """
    known, slot = fresh("_mixed_id", docs.columns), fresh("_mixed_slot", docs.columns)
    chosen = mix(docs, **options).where("kept").groupBy(F.col("doc_id").alias(known)).agg(F.min("slot").alias(slot))
    mixed = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen[known])).drop(known)
    return mixed.repartitionByRange(slot).sortWithinPartitions(slot, "doc_id").drop(slot)
