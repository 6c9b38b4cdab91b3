"""Personal data, the prefix trie and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import frames
import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import common, pii, resampling, trie
from vellum.llm.common import table

SF = "/root/testdata/sf0.001"


# ---- personal data


def plain_spans(text):
    """The fixed patterns, as they are written down."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m.group())) <= 15]
    return sorted(out)


def test_fixed_patterns_are_as_written():
    rng = random.Random(4)
    pieces = ["a@b.c", "x.y%z@d-e.co", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (499) 555-6503", "+", "12", "٣", "é", " ", "  ", "-", "(", ")", "a", "\n", "999", "007.0.0.1", "b@c", "_", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    # no word is tried at every letter
    long = "a" * 300_000 + " 1" + "2" * 300_000 + "." * 1000 + "@" * 1000 + "+1" + "(" * 1000
    assert pii.base_spans(long) == [] and len(pii.candidates(long)) < 10


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(table(spark, SF, "documents"))


def test_the_trees_know_unseen_examples(spark, model):
    contexts = pii.contexts_of(table(spark, "/root/testdata/sf0.01", "documents"), 300)
    x, y, kinds = pii.examples(contexts, 3000, 77)
    taken = model.trees.score(x) >= np.array(model.thresholds)[kinds]
    for k, name in enumerate(pii.KINDS):
        own = kinds == k
        assert y[own & taken].mean() > 0.97 and y[own & taken].sum() > 0.85 * y[own].sum(), name


def test_what_is_added_and_what_is_left_alone(spark, model):
    found = ["Write to jo.doe [at] example [dot] com today.", "Call (499) 555-6503 now.", "My card: 4111.1111.1111.1111 thanks.", "IBAN DE89 3704 0044 0532 0130 00 is mine.", "social security 512-34-5678 it is", "host 2001:db8::ff00:42:8329 answers"]
    clean = ["On 2023-04-05 at 10:20:30 we met.", "Version 1.2.345.6 of it.", "It costs 1,234,567.89 in all.", "We met at home. Then we left.", "ISBN 978-3-1614-8410-0 is a book.", "abc 5927243074273351 def", "9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "", None, "2019-2023 and 10 20 30 40"]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(found + clean)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    kinds = ["email", "phone", "card", "iban", "ssn", "ip"]
    for k, text in enumerate(found):
        own = [s.split(":") for s in got[k].spans.split(",")]
        assert [s[0] for s in own] == [kinds[k]] and len(text) > int(own[0][2]) > int(own[0][1]) > 0 and got[k].base == "", text
    assert all(got[k].spans == "" for k in range(len(found), len(got)))
    redacted = {r.doc_id: r.redacted for r in pii.redact(docs, pii.find(docs, model)).collect()}
    assert redacted[1] == "Call [phone] now." and redacted[len(found) + 8] is None and redacted[len(found) + 7] == ""


def test_pii_rows_and_counts(spark, model):
    df = frames.documents(spark, extra=frames.CLASH).unionByName(
        spark.createDataFrame([(50, "mail a@b.co or +1 (499) 555-6503, 8.8.8.8 " * 40, None, None, 1)], frames.SCHEMA), allowMissingColumns=True
    )
    rows = pii.find(df, model, at_once=8).collect()
    assert len(rows) == df.count()
    texts = defaultdict(list)
    for r in df.collect():
        texts[r.doc_id].append(r.text or "")
    for r in rows:
        assert any(
            pii.joined(plain_spans(t)) == r.base and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in plain_spans(t)) for n in range(4)] for t in texts[r.doc_id]
        )
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert pii.find(df.limit(0), model).count() == 0


def test_whole_table_has_the_fixed_spans(spark, model):
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r for r in pii.digests(pii.find(docs, model)).collect()}
    for r in docs.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.joined(plain_spans(r.text)).encode()).hexdigest()


# ---- trie


def plain_trie(rows, rebuild):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [t for _, t in sorted(ts, key=lambda x: x[0])] for c, ts in turns.items()}
    if rebuild:
        h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
        own = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(set)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    kids, below = Counter(n[:-1] for n in members if n), defaultdict(lambda: [0, 0])
    for n, m in members.items():
        for d in range(len(n) + 1):
            below[n[:d]][0] += n not in kids
            below[n[:d]][1] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(own[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], *below[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("chunk, piece, fan", [(200_000, 1024, 256), (7, 2, 2)])
def test_nodes_are_those_of_a_plain_trie(spark, monkeypatch, chunk, piece, fan):
    for name, value in (("CHUNK", chunk), ("PIECE", piece), ("FAN", fan)):
        monkeypatch.setattr(trie, name, value)
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 60), 100, 103, 107]:
        stem = rng.choice([0, 1, 2])
        rows += [(c, t, rng.choice(["user", "user", None]), f"s{stem} t{t // 2}" if rng.random() < 0.8 else rng.choice(["", None, "ü"])) for t in range(rng.randint(1, 9))]
    rows += [(5, None, "user", "first"), (5, None, "user", "first"), (None, 1, "user", "lost"), (7, 2, "user", "tie"), (7, 2, "user", "other"), (8, 1, None, None)]
    rows += [(c, t, "user", f"same {t}") for c in (200, 201, 202, 203) for t in range(40)]  # copies of a long one, a hot key
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, id int").repartition(5)
    order = lambda out: sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))
    assert order(trie.rebuilt_trie(df)) == plain_trie(rows, True)
    assert order(trie.trie_of(df)) == plain_trie(rows, False)


def test_a_conversation_may_be_dealt_over_many_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, "user", f"t{t}" if c < 3 or t < 150 else f"own {c} {t}") for c in (1, 2, 3) for t in range(300)]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        got = sorted(map(tuple, trie.trie_of(df).collect()), key=lambda r: (r[0], r[1]))
        assert got == plain_trie(rows, False)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_turnless_and_no_conversations(spark):
    df = spark.createDataFrame([(0, 0, "user", "x"), (1, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    # 1 % 5 is 1, so the conversation begins with turns of 0; with more heads asked for than there are turns, its own go
    h = zlib.crc32(b"1") % 9
    assert h > 0 and sorted(map(tuple, trie.rebuilt_trie(df).collect()), key=lambda r: (r[0], r[1])) == plain_trie([tuple(r) for r in df.collect()], True)
    gone = df.where("conv_id = 1")
    only = [tuple(r) for r in trie.rebuilt_trie(gone).collect()]
    assert only == plain_trie([tuple(r) for r in gone.collect()], True) and len(only) == 1 and only[0][:3] == (1, 0, None)
    assert trie.rebuilt_trie(df.limit(0)).count() == 0


# ---- resampling


def plain_resample(docs, target, percent=25, least=20):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def runs(text):
        w = word.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own = [(i, *runs(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in own for f in fs), Counter(bucket(f) for x in target for f in runs(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for i, n, fs in own:
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_resampling_is_the_plain_one(spark):
    df = frames.documents(spark, extra=("rank", "id", "bucket", "n_features", "row", "word")).unionByName(
        spark.createDataFrame([(k, f"{frames.prose(random.Random(k % 4), 25)} ÀÉ 12x", None, None, 1) for k in range(100, 160)] * 2, frames.SCHEMA), allowMissingColumns=True
    ).repartition(6)
    target = spark.createDataFrame([("12es 34ES 1bes ÀÉ 12X",), (None,), ("",)], "text string")
    got = sorted((tuple(r) for r in resampling.resample(df, target).collect()), key=str)
    assert got == plain_resample([(r.doc_id, r.text) for r in df.collect()], [r.text for r in target.collect()])
    assert sum(r[5] is not None for r in got) == sum(r[1] >= 20 for r in got) * 25 // 100
    # no target: the corpus alone; no documents: no rows
    assert sorted((tuple(r) for r in resampling.resample(df, target.limit(0)).collect()), key=str) == plain_resample([(r.doc_id, r.text) for r in df.collect()], [])
    assert resampling.resample(df.limit(0), target).count() == 0


def test_places_over_the_whole_table(spark):
    rows = [(random.Random(k).randint(0, 9),) for k in range(500)] + [(3,)] * 2000
    df = spark.createDataFrame(rows, "x long").repartition(7)
    got = [r.x for r in common.numbered(df, [F.col("x").desc()], "at", "some").orderBy("at").collect()]
    assert got == sorted((r[0] for r in rows), reverse=True)
    assert sorted(r.at for r in common.numbered(df, [F.col("x")], "at", "some").collect()) == list(range(2500))
