"""SimHash and substring dedup against brute force."""

import hashlib
import random
import re

import frames
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import simhash, substring
from vellum.llm.components import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """rows: (doc_id, fingerprint); smallest doc_id reachable, for every row."""
    left, out = set(range(len(rows))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            more = {j for j in left if (rows[i][1] ^ rows[j][1]).bit_count() <= radius}
            left -= more
            todo += more
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return [out[i] for i in range(len(rows))]


def test_fingerprints_follow_sparks_hash(spark):
    text = "The quick Brown fox jumps"
    rows = spark.sql("SELECT xxhash64('the quick brown fox') AS h").first()
    assert rows.h % 2**64 == xxhash.xxh64_intdigest("the quick brown fox", 42)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_groups(spark):
    df = frames.documents(spark, extra=frames.CLASH)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, p), c in zip(prints, brute_components(prints)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == want


@pytest.mark.parametrize("chunk", [4096, 16])
def test_bit_slices_find_every_near_pair(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(4)
    values = []
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 30)):
            v = base
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(64)
            values.append(v)
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame([(i, v - 2**64 if v >= 2**63 else v) for i, v in rows], "doc_id long, fp long")
    classes = simhash._classes(df)
    got = {r.doc_id: r.component_id for r in df.join(classes, "fp").collect()}
    assert [got[i] for i, _ in rows] == brute_components(rows)


@pytest.mark.parametrize("radius", range(8))
def test_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 1, np.uint64)[0]
    values = np.array([base ^ np.uint64(int(sum(1 << int(b) for b in rng.choice(64, k, False)))) for k in rng.integers(0, 9, 150)], np.uint64)
    found = {(int(i), int(j)) for a, b in simhash.near(values, np.full(150, 150), radius, block=64) for i, j in zip(a, b)}
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if int(values[i] ^ values[j]).bit_count() <= radius}
    assert found == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{k: 100 for k in range(101, 140)}, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_of_each_group_stays(spark):
    df = frames.documents(spark, extra=frames.CLASH)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    groups = simhash.near_duplicates(df).select("component_id").distinct().collect()
    assert ids == sorted(str(r.component_id) for r in groups)
    empty = df.limit(0)
    assert simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_firsts(rows):
    """rows: (doc_id, text); for each row the smallest doc_id that links of Jaccard 0.8 over five words reach."""
    sets = [shingle_set(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            more = {j for j in left if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
            left -= more
            todo += more
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return [out[i] for i in range(len(rows))]


def near_copies(seed=11):
    """Families of texts with words changed here and there, of similarities on both sides of the bound."""
    rng = random.Random(seed)
    rows = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 12, 60, 200, 700]))]
        for _ in range(rng.choice([1, 2, 2, 9])):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 99)}"
            rows.append((rng.randint(0, 400), " ".join(own)))
    return rows


@pytest.mark.parametrize("crowd, chunk", [(512, 4096), (8, 4096), (512, 64)])
def test_near_copies_leave_one(spark, monkeypatch, crowd, chunk):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_known", F.lit(1)).withColumn("row", F.lit("r"))
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got, want = {r.doc_id for r in kept.collect()}, set(brute_firsts(rows))
    if chunk == 64:  # chunks of a bucket meet in no other table here, so some copies may stay, but nothing else goes
        assert want <= got
    elif crowd == 8:  # sampled bits: nearly every group is found
        assert want <= got and len(got) <= 1.05 * len(want)
    else:
        assert got == want


def test_pairs_in_a_crowd_of_one_template_are_found(spark, monkeypatch):
    # texts of one template have a similarity of 0.75, so they are no duplicates; every tenth has a near copy of 0.85
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**9)}"
    template, rows, pairs = " ".join(word() for _ in range(343)), [], []
    for k in range(1500):
        own = [word() for _ in range(57)]
        rows.append((k, f"{template} {' '.join(own)}"))
        if k % 10 == 0:
            near = own[:24] + [word() for _ in range(33)]
            rows.append((10_000 + k, f"{template} {' '.join(near)}"))
            pairs.append(k)
    similar = lambda a, b: len(a & b) / len(a | b)
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = dict(rows)
    assert similar(shingles(texts[1]), shingles(texts[2])) < 0.76 and 0.83 < similar(shingles(texts[0]), shingles(texts[10_000])) < 0.87
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    # nothing but the copies goes, and nearly all of them
    assert set(range(1500)) <= kept and sum(10_000 + k not in kept for k in pairs) >= 0.95 * len(pairs)


@pytest.mark.parametrize("part", [1024, 50])
def test_links_that_the_forests_of_a_crowd_leave_out_are_found(spark, monkeypatch, part):
    # one bucket of texts at 0.75, which are no duplicates; copies of 0.81 are hardly nearer in bits than the others
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    template, rows = " ".join(word() for _ in range(343)), []
    for k in range(400):
        own = [word() for _ in range(57)]
        rows.append((k, f"{template} {' '.join(own)}"))
        if k % 10 == 0:
            rows.append((10_000 + k, f"{template} {' '.join(own[:16] + [word() for _ in range(41)])}"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    assert all(0.8 <= len(sets[k] & sets[10_000 + k]) / len(sets[k] | sets[10_000 + k]) < 0.82 for k in range(0, 400, 10))
    kept = {r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id").collect()}
    assert kept == set(range(400))


def test_shared_shingles_are_counted():
    rng = np.random.default_rng(8)
    for n, values in ((1, 5), (30, 40), (300, 9), (300, 5000)):
        texts = [np.unique(rng.integers(0, values, rng.integers(0, 60)).astype(np.int32)) for _ in range(n)]
        got = simhash.shared(texts)
        want = [[len(np.intersect1d(a, b)) for b in texts[:25]] for a in texts]
        off = ~np.eye(n, dtype=bool)[:, :25]
        assert (got[:, :25][off] == np.array(want).reshape(n, -1)[off]).all()


def test_the_stage_tells_rows_of_one_id_apart(spark):
    rng = random.Random(3)
    a, b = (" ".join(f"{c}{rng.randint(0, 999)}" for _ in range(50)) for c in "ab")
    rows = [(1, a), (1, b), (1, b), (2, a), (None, a), (None, "c d e"), (None, "C d  e"), (5, ""), (6, None), (5, " ")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4 and {(r.doc_id, r.text) for r in kept if r.doc_id == 1} == {(1, a), (1, b)}
    assert [r.text.lower().split() for r in kept if r.doc_id is None] == [["c", "d", "e"]] and [r.doc_id for r in kept if not (r.text or "").strip()] == [5]


def test_the_forest_spans_at_least_distance():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n, m = 40, 120
        i, j, apart = rng.integers(0, n, m), rng.integers(0, n, m), rng.integers(0, 9, m)
        i, j = np.minimum(i, j), np.maximum(i, j)
        keep = simhash.spanning(n, i, j, apart)
        for most in range(10):  # as many components below every distance as all links make
            sizes = []
            for chosen in (np.arange(m), keep):
                labels = np.arange(n)
                own = chosen[apart[chosen] <= most]
                simhash.join_labels(labels, i[own], j[own])
                sizes.append(len(set(labels.tolist())))
            assert sizes[0] == sizes[1]


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from vellum.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    rows = spark.createDataFrame([(0 if i % 2 else i, i) for i in range(100)], "k long, v long")
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("k") + 1)
    out = common.join_hot(rows, keyed, ["k"], "n", 100)
    assert sorted(out.columns) == ["k", "v", "w"] and sorted((r.k, r.v, r.w) for r in out.collect()) == sorted((r.k, r.v, r.k + 1) for r in rows.collect())
    assert simhash.blocks_for(10**6) == 6 < simhash.blocks_for(10**13)


def brute_removed(rows):
    """rows: (doc_id, text); (words, removed flags) of every row."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, ws in words:
        for k in range(len(ws) - 12):
            if i is not None:
                w = tuple(ws[k : k + 13])
                least[w] = min(i, least.get(w, i))
    out = []
    for i, ws in words:
        gone = [False] * len(ws)
        for k in range(len(ws) - 12):
            if i is not None and least[tuple(ws[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((ws, gone))
    return out


def shared_passages(spark, seed=2):
    rng = random.Random(seed)
    passages = [[f"p{k}_{rng.randint(0, 30)}" for _ in range(rng.randint(11, 60))] for k in range(6)]
    rows = []
    for i in range(80):
        ws = []
        for _ in range(rng.randint(0, 5)):
            ws += [f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))]
            p = rng.choice(passages)
            a = rng.randint(0, len(p) - 1)
            ws += p[a : a + rng.randint(1, 60)]
        rows.append((rng.randint(0, 60), " ".join(ws)))
    rows += [(5, "same " * 40), (6, "same " * 40), (7, "same " * 12)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("part_bytes", [1 << 23, 600])
def test_repeats(spark, part_bytes):
    for df in (frames.documents(spark, extra=frames.CLASH), shared_passages(spark)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = []
        for (i, _), (ws, gone) in zip(rows, brute_removed(rows)):
            kept = " ".join(w for w, g in zip(ws, gone) if not g)
            want.append((str(i), len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        got = substring.digests(substring.remove_repeats(df, part_bytes)).collect()
        assert sorted(want) == sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)


def test_cut_texts_keep_their_columns_and_space(spark):
    long = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, f"x\n{long}  y"), (2, f"q\n\n{long}\tz\n"), (3, long), (4, "as  it\twas"), (5, None)], "doc_id long, text string").withColumn("part", F.lit(3)).withColumn("n_chars", F.lit(9))
    got = {r.doc_id: r for r in substring.without_repeats(df).collect()}
    assert substring.without_repeats(df).columns == df.columns
    assert got[1].text == f"x\n{long}  y" and got[2].text == "q\n\nz\n" and 3 not in got
    assert got[4].text == "as  it\twas" and got[2].n_chars == 5 and got[1].n_chars == 9 and got[2].part == 3 and 5 in got


def test_empty_table(spark):
    df = frames.documents(spark).limit(0)
    assert substring.remove_repeats(df).count() == 0 and substring.without_repeats(df).count() == 0


def test_cover_meets_every_pair_of_places():
    for i in range(7):
        for j in range(7):
            assert any((i + d) % 7 in substring.COVER and (j + d) % 7 in substring.COVER for d in range(7))


def test_files_and_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(substring, "FILES", 3)
    monkeypatch.setattr(substring, "BUCKETS", 5)
    df = shared_passages(spark, 4)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted((str(i), sum(gone)) for (i, _), (_, gone) in zip(rows, brute_removed(rows)))
    # far more parts than a table may have buckets
    assert sorted((str(r.doc_id), r.n_removed) for r in substring.remove_repeats(df, 1).collect()) == want
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def test_windows_of_one_hash_are_told_apart_by_their_check(monkeypatch):
    keys = np.zeros(6, substring.KEY)
    keys["hash"], keys["check"] = [5, 5, 5, 7, 7, 9], [1, 2, 1, 3, 4, 0]
    order, new = substring.grouped(keys, np.array([3, 1, 2, 1, 1, 1]))
    assert order.tolist() == [2, 0, 1, 3, 4, 5] and new.tolist() == [True, False, True, True, True, True]
    known = keys[[0, 1, 4]]
    assert substring.held(keys, known).tolist() == [True, True, True, False, True, False]
    assert not substring.held(keys, known[:0]).any()


def test_null_ids_are_spread_over_parts(spark):
    rng = random.Random(1)
    rows = [(None if i % 2 else i % 4, " ".join(str(rng.randint(0, 99)) for _ in range(20))) for i in range(60)]
    texts, _ = substring._parts(spark.createDataFrame(rows, "doc_id long, text string"), 100, [])
    parts = texts.where("doc_id IS NULL").select("part").distinct().count()
    assert parts > 5
