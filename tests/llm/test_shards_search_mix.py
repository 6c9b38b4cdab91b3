"""Sharding, top-k search and mixing against brute force and their own laws."""

import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import frames
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import mixing, sharding, topk


def test_differencing_is_tight():
    rng = random.Random(2)
    sizes = [rng.randint(1, 10_000) for _ in range(400)]
    bins = sharding.difference([[s, 0, 0, 0, 0, 0, 0, 0] for s in sizes])
    sums = [0] * 8
    for s, b in zip(sizes, bins):
        sums[b[0]] += s
    assert max(sums) - min(sums) <= 8
    assert sharding.difference([]) == []
    # known case: 8, 7, 6, 5, 4 differences to 2
    two = sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)])
    assert abs(sum(x if b[0] else -x for x, b in zip((8, 7, 6, 5, 4), two))) == 2


def check_shards(df, n_shards=24):
    rows = sharding.shard_documents(df, n_shards=n_shards, slot_rows=4).collect()
    source = df.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in source)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    by_shard, by_text = {}, {}
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < n_shards
        by_shard.setdefault(r.shard, []).append(r.slot)
        by_text.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert all(len(v) == 1 for v in by_text.values())
    return rows


def test_shards(spark):
    check_shards(frames.documents(spark, extra=frames.CLASH))
    assert check_shards(frames.documents(spark).limit(0)) == []


def test_shards_are_even(spark):
    rng = random.Random(4)
    rows = [(i, "z" * rng.randint(0, 3000) + str(i % 1900)) for i in range(2000)]
    rows += [(3000 + i, "the same text again and again") for i in range(700)]  # one group of many rows
    sums = defaultdict(int)
    for r in check_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8):
        sums[r.shard] += r.size
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 64


def test_many_buckets_meet_in_levels(spark):
    rng = random.Random(9)
    rows = [(str(i).encode(), rng.randint(1, 5000)) for i in range(600)]
    groups = spark.createDataFrame(rows, "key binary, bytes long")
    got = sharding.assign_groups(groups, 6, bucket_rows=10, fan_in=4).collect()
    size = dict(rows)
    sums = [0] * 6
    for r in got:
        sums[r.shard] += size[bytes(r.key)]
    assert len(got) == 600 and max(sums) - min(sums) < 100


def brute_search(rows, k=20, every=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in ok:
        if q % every == 0:
            best = sorted((-int(v @ w), i) for i, w in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_top_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=16) / 4]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(80)]  # ties
    rows += [(900, None), (901, [1.0, None] * 8), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (None, rows[0][1]), (920, [0.0] * 16), (940, [-3.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    for sizes in ({}, {"block_rows": 50, "group_rows": 5}):
        got = {tuple(r) for r in topk.search(df, **sizes).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == brute_search(rows)
    few = df.where("vec_id IN (0, 1, 2)")
    assert topk.search(few).count() == 2 and topk.search(df.limit(0)).count() == 0


def test_slices_add_up():
    rng = np.random.default_rng(3)
    matrix, query = rng.integers(-70, 70, (130, 9)), rng.integers(-70, 70, 9)
    low, stack = topk.slices_of(matrix)
    base, slices = topk.add_slices(query, low, stack)
    total = np.full(130, base)
    for place, s in enumerate(slices):
        total += np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << place
    assert (total == matrix @ query).all()
    assert all(sum(s << p for p, s in topk.signed_digits(x)) == x for x in range(-70, 70))


def test_schedule_stays_within_one_block():
    rng = random.Random(7)
    for _ in range(30):
        names = [f"s{i}" for i in range(rng.randint(1, 9))]
        blocks, weights = {s: rng.randint(0, 60) for s in names}, {s: rng.randint(1, 50) for s in names}
        rows = mixing.schedule(blocks, weights, 0.0)
        assert [r[4] for r in rows] == list(range(len(rows)))
        assert all(release <= slot < due for _, _, release, due, slot in rows)
        assert {s: sum(r[0] == s for r in rows) for s in names} == blocks
        active = {s for s in names if blocks[s]}
        total, given = sum(weights[s] for s in active), dict.fromkeys(active, 0)
        for t, (s, *_) in enumerate(rows, 1):
            given[s] += 1
            assert all(abs(given[x] - t * weights[x] / total) < mixing.STEPS / 2 for x in active)
            if given[s] == blocks[s]:
                break


def test_mix(spark):
    df = frames.documents(spark, extra=frames.CLASH)
    rows = mixing.mix(df, block_bytes=64, least_weight=0.0).collect()
    assert len(rows) == df.count() and all(r.kept for r in rows)
    kept = mixing.mix(df, weights={"s1": 1.0, "s2": 1.0}, block_bytes=64)
    assert {r.source for r in kept.where("kept").collect()} <= {"s1", "s2"}
    out = mixing.keep_mixed(df, block_bytes=64, least_weight=0.0)
    assert out.columns == df.columns and out.count() == df.count()
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.keep_mixed(df.limit(0)).count() == 0


def test_every_document_is_in_the_mix(spark):
    # small sources run out first; the hot one holds a third of the weight
    rows = [(i, "x" * 99, "hot" if i < 400 else f"s{i % 12}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, block_bytes=200).collect()
    assert len(out) == 700 and all(r.kept and r.slot is not None for r in out)
    assert sorted(r.doc_id for r in mixing.keep_mixed(df, block_bytes=200).collect()) == list(range(700))
    # a cut has to be asked for
    assert 0 < mixing.mix(df, block_bytes=200, least_weight=0.5).where("kept").count() < 700


def exact_search(rows, k=20, every=20):
    """As brute_search, in Python's integers."""
    ok = [(i, [math.floor(Fraction(x) * 64) for x in v]) for i, v in rows]
    out = set()
    for q, v in ok:
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def test_large_components_take_part(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 4]) for i in range(200)]
    rows += [(200 + i, [float(np.float32(x)) for x in rng.normal(size=8) * 2**20]) for i in range(50)]
    rows += [(300, [2.0**24] + [0.0] * 7), (301, [-(2.0**25)] + [0.5] * 7), (302, [0.25] * 7 + [3 * 2.0**24]), (303, [0.0] * 7 + [2.0**26]), (320, [0.125] * 7 + [2.0**24])]
    # scores below all longs, as no query has a negative component; they never are among the best
    rows += [(321, [0.0] * 7 + [-(2.0**62)]), (323, [-(2.0**90)] + [0.0] * 7)]
    rows = [(i, v if i % 20 else [abs(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = exact_search(rows)
    assert all(-(2**63) <= s < 2**63 for *_, s in want) and {300, 320} <= {q for q, *_ in want}
    for sizes in ({}, {"block_rows": 40, "group_rows": 5}):
        assert {tuple(r) for r in topk.search(df, **sizes).collect()} == want


@pytest.mark.parametrize("sign", [1.0, -1.0])
def test_a_score_beyond_a_long_is_an_error(spark, sign):
    df = spark.createDataFrame([(20, [2.0**30]), (21, [sign * 2.0**30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="passes a long"):
        topk.search(df).collect()


def test_empty_and_repeated_query_vectors(spark):
    rows = [(20, []), (21, []), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.search(df).collect()} == exact_search(rows)
    # rows of one query id that differ: the first by components asks, and no row of its own id answers
    rows = [(20, [2.0, 0.0]), (20, [1.0, 5.0]), (20, [1.0]), (3, [1.0, -1.0]), (3, [1.0, -1.0]), (4, []), (5, [0.5, 0.5, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r)[1:] for r in topk.search(df).orderBy("rank").collect()]
    assert got == [(1, 3, 64 * 64), (2, 3, 64 * 64), (3, 5, 64 * 32), (4, 4, 0)]


def off_target(weights, slots, period):
    """The farthest that any source is from its exact share of the first slots, over all slots, in steps."""
    exact = mixing.whole_weights(weights)
    total, shares, given, worst = sum(exact.values()), mixing.Shares(exact), dict.fromkeys(exact, 0), 0
    for begin in range(0, slots, period):
        for s, k, release, deadline, at in mixing.run_of(shares, begin, min(begin + period, slots)):
            assert k == given[s] and release <= at < deadline
            # the farthest behind before its own step, the farthest ahead after it
            behind, ahead = Fraction(exact[s] * at, total) - k, k + 1 - Fraction(exact[s] * (at + 1), total)
            given[s] += 1
            worst = max(worst, behind, ahead)
        assert sum(given.values()) == min(begin + period, slots)
        worst = max(worst, *(abs(given[s] - Fraction(exact[s] * sum(given.values()), total)) for s in exact))
    return worst


@pytest.mark.parametrize("weights, slots", [
    ({"a": 1 / 3, "b": 2 / 3}, 10**6), ({"a": 1e-5, "b": 1 - 1e-5}, 400_000), ({f"s{i}": random.Random(i).random() ** 3 for i in range(2000)}, 60_000),
    ({f"s{i}": 1.618**-i for i in range(25)}, 60_000), ({"a": 1, "b": 10**9, "c": 1}, 60_000),
])
def test_every_source_stays_by_its_exact_weight(weights, slots):
    assert off_target(weights, slots, 8192) <= 3


def test_shares_are_exact_far_out():
    weights = mixing.whole_weights({"a": 1 / 3, "b": 0.1, "c": 1e-9, "d": 7.5})
    shares, total = mixing.Shares(weights), sum(weights.values())
    for n in (10**6, 10**12 + 7, 10**15 + 1):
        at = shares.at(n)
        assert sum(at.values()) == n and all(abs(at[s] - Fraction(weights[s] * n, total)) <= 2 and at[s] == shares.of(s, n) for s in weights)
        assert all(0 <= shares.at(n + 1)[s] - at[s] <= 1 for s in weights)
    k = shares.reaches("c", 5, weights, total)
    assert shares.of("c", k) == 5 and shares.of("c", k - 1) == 4


def test_every_step_has_one_slot():
    rng = random.Random(12)
    for _ in range(25):
        names = [f"s{i}" for i in range(rng.randint(1, 6))]
        steps, weights = {s: rng.randint(0, 400) for s in names}, {s: rng.randint(1, 50) for s in names}
        out = mixing.schedule(steps, weights, period=64)
        assert [r[4] for r in out] == list(range(sum(steps.values()))) and sorted(r[:2] for r in out) == sorted((s, k) for s in names for k in range(steps[s]))
        assert all(release <= slot < deadline for _, _, release, deadline, slot in out)
        # the first phase ends with the step with which a source runs out
        first = [p for p in mixing.plan(steps, weights) if p[1] == 0]
        assert not first or [p[3] == steps[p[0]] for p in first].count(True) == 1
    assert mixing.plan({}, {}) == [] and mixing.schedule({"a": 3}, {"a": 0.0}) == []


@pytest.mark.parametrize("longest", [100, 5000])
def test_mix_end_to_end(spark, longest):
    rng = random.Random(longest)
    rows = [(i, "y" * rng.randint(0, longest), rng.choice(["a", "a", "a", "b", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    block, step, period = 512, 512 // mixing.STEPS, 128
    out = mixing.mix(df, block_bytes=block, period=period).collect()
    assert len(out) == 1500 and all(r.kept and r.release <= r.slot < r.deadline for r in out)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
    total = {s: sum(r.bytes for r in own) for s, own in by.items()}
    # every step's slot, release and deadline are those of the schedule written out
    weights = {s: float(t) ** 0.8 for s, t in total.items()}
    steps = {s: -(-t // step) for s, t in total.items()}
    plain = {(s, j): times for s, j, *times in mixing.schedule(steps, weights, period=period)}
    assert all(plain[r.source, r.block] == [r.release, r.deadline, r.slot] for r in out)
    # documents stand at the step of their middle
    for s, own in by.items():
        own.sort(key=lambda r: r.block)
        assert all(0 <= r.block < steps[s] for r in own)
    # until a source runs out, each has had its exact share of the slots' bytes to within a block or the longest document
    most = max(block, max(r.bytes for r in out))
    first_end = min(max(r.slot for r in own) for own in by.values())
    slots = sorted(out, key=lambda r: r.slot)
    given, at = dict.fromkeys(by, 0), 0
    for t in range(1, first_end + 1):
        while at < len(slots) and slots[at].slot < t:
            given[slots[at].source] += slots[at].bytes
            at += 1
        assert all(abs(given[s] - t * step * weights[s] / sum(weights.values())) < most for s in by)
    # sources without a weight stay out
    some = mixing.mix(df, weights={"a": 2.0}, block_bytes=block)
    assert {r.source for r in some.where("kept").collect()} == {"a"} and some.where("NOT kept AND slot IS NULL").count() == len(by["b"]) + len(by[""])
