"""Chunks, retrieval, prompts, experiments and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunk, experiments, retrieve
from vellum.sources import ocr
from vellum.streaming import stream


def greedy(sentences, most, overlap):
    """A plain model of token-greedy chunks over (sentence, tokens)."""
    done, now = [], []
    for s, n in sentences:
        if now and sum(k for _, k in now) + n > most:
            done.append(now)
            tail, size = [], 0
            for x in reversed(now):
                if size + x[1] > overlap:
                    break
                tail.insert(0, x)
                size += x[1]
            now = tail if size + n <= most else []
        now = [*now, (s, n)]
    return done + ([now] if now else [])


def test_token_chunks(spark):
    rng = random.Random(1)
    docs = []
    for i in range(40):
        docs.append((i, " ".join(" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 9))) + "." for _ in range(rng.randint(0, 12)))))
    got = {}
    for r in chunk.token_chunks(spark.createDataFrame(docs, "doc_id int, text string"), 12, 4, 0).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for i, text in docs:
        sentences = [(s + ".", len(s.split())) for s in text.replace(".", "|").split("|") if s.strip()]
        sentences = [(s.strip(), n) for s, n in sentences]
        assert got.get(i, []) == [" ".join(s for s, _ in c) for c in greedy(sentences, 12, 4)]


def test_sentence_windows_and_offsets(spark):
    df = spark.createDataFrame([(1, "A. B? C! D. E."), (2, "")], "doc_id int, text string")
    rows = chunk.with_offsets(chunk.sentence_chunks(df)).orderBy("chunk_id").collect()
    assert [r.text for r in rows] == ["A. B? C! D.", "C! D. E.", "E."]
    assert [(r.char_start, r.char_end) for r in rows] == [(0, 11), (12, 20), (21, 23)]


def test_retrieval(spark):
    chunks = spark.createDataFrame([("s", i, [float(i), 1.0]) for i in range(8)] + [("t", 99, [100.0, 1.0])], "session_id string, chunk_id int, embedding array<float>")
    queries = spark.createDataFrame([(1, "s", [1.0, 0.0]), (2, "none", [1.0, 0.0])], "query_id int, session_id string, query array<float>")
    hits = retrieve.top_k(queries, chunks, 3)
    assert [(r.rank, r.chunk_id, r.score) for r in hits.orderBy("rank").collect()] == [(1, 7, 7.0), (2, 6, 6.0), (3, 5, 5.0)]
    assert retrieve.above(hits, 6.0).count() == 2
    answers = {r.query_id: r for r in retrieve.answers(queries, hits).collect()}
    assert answers[1].answer is None and answers[2].answer == retrieve.NOT_FOUND and answers[2].intent == "unknown"


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, "aaa"), (1, 2, "bbbbbb"), (1, 3, "c")], "query_id int, rank int, text string")
    kept = retrieve.within_budget(rows, 4)
    assert [r.rank for r in kept.collect()] == [1]
    got = retrieve.context(retrieve.within_budget(rows, 100)).first()
    assert got.context == "[Source 1]\naaa\n\n[Source 2]\nbbbbbb\n\n[Source 3]\nc" and got.context_chars == 10


def test_prompts_fill_every_place(spark):
    rows = spark.createDataFrame([(i, v) for i, v in (("finance", "A"), ("finance", "B"), ("summary", "B"), ("retrieval", "A"))], "intent string, variant string")
    got = rows.select(retrieve.fill(F.col("intent"), F.col("variant"), F.lit("CTX"), F.lit("what is {context}?"))).collect()
    assert all("CTX" in p[0] and "{question}" not in p[0] and "what is {context}?" in p[0] for p in got)
    assert got[1][0].endswith("Be brief.")


def test_decisions(spark):
    rows = [("x", v, c) for v, c, n in (("A", 0.5, 60), ("B", 0.7, 60)) for _ in range(n)]
    rows += [("y", v, 0.5) for v in "AB" for _ in range(100)] + [("z", "A", 0.5)]
    df = spark.createDataFrame(rows, "intent string, variant string, composite double")
    got = {r.intent: (r.decision, r.winner) for r in experiments.decision(df).collect()}
    assert got == {"x": ("conclude", "B"), "y": ("equivalent", "A"), "z": ("continue", None)}


def test_summary_leaves_out_nulls(spark):
    df = spark.createDataFrame([("A", "f", 0.5, 1.0, 0.1), ("A", "f", 0.7, 2.0, 0.2), (None, "f", 1.0, 1.0, 1.0)], "variant string, intent string, composite double, latency double, cost double")
    row = experiments.summary(df).collect()
    assert len(row) == 1 and tuple(row[0]) == ("A", "f", 0.6, 0.141, 2, 1.5, 0.3)


def test_landed_files_once(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()
    for n in range(3):
        (inbox / f"s{n}_raw.json").write_text(json.dumps({"JobId": "j", "JobStatus": "SUCCEEDED", "Blocks": [{"Id": "a", "BlockType": "LINE", "Text": "t"}]}))
    stream.drain(stream.landed_responses(spark, str(inbox)), out, mark)
    (inbox / "s9.json").write_text(json.dumps({"Blocks": []}))
    stream.drain(stream.landed_responses(spark, str(inbox)), out, mark)
    assert sorted(r.session_id for r in spark.read.parquet(out).collect()) == ["s0", "s1", "s2", "s9"]
    assert ocr.blocks(spark.read.parquet(out)).count() == 3


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    events = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    query = stream.windowed_counts(events).writeStream.format("memory").queryName("w").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == spark.read.parquet(str(src)).count()


def test_top_k_of_a_hot_session_in_runs(spark):
    import random

    from vellum.operators import retrieve

    rng = random.Random(4)
    chunks = [("hot" if k % 2 else f"s{k % 40}", k, [rng.randint(-3, 3) / 1.0 for _ in range(4)]) for k in range(600)]
    queries = [(k, s, [rng.randint(-3, 3) / 1.0 for _ in range(4)]) for k, (s, *_) in enumerate(chunks) if k % 3 == 0]
    queries += [(9000, None, [1.0] * 4), (9001, "empty", [1.0] * 4)]
    a = spark.createDataFrame(queries, "query_id long, session_id string, query array<double>")
    b = spark.createDataFrame(chunks, "session_id string, chunk_id long, embedding array<double>")
    for run in (16, 1024):
        got = {}
        for r in retrieve.top_k(a, b, 5, run).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
        for q, session, v in queries:
            scored = sorted(((c, sum(x * y for x, y in zip(v, e))) for s, c, e in chunks if s == session), key=lambda h: (-h[1], h[0]))[:5]
            assert got.get(q, []) == scored


def test_pages_of_a_long_document(spark):
    from vellum.operators import chunk

    pages = spark.range(100_000).selectExpr("1L AS doc_id", "id * 7 AS page_start", "int(id) + 1 AS page").union(spark.sql("SELECT 2L, 10L, 4"))
    chunks = spark.range(50_000).selectExpr("1L AS doc_id", "id AS chunk_id", "id * 13 AS char_start").union(spark.sql("SELECT 2L, 0L, 9L UNION ALL SELECT 2L, 1L, 10L UNION ALL SELECT 3L, 0L, 0L"))
    got = {(r.doc_id, r.chunk_id): r.page_ref for r in chunk.page_refs(chunks, pages).collect()}
    assert got.pop((2, 0)) is None and got.pop((2, 1)) == 4 and got.pop((3, 0)) is None
    assert len(got) == 50_000 and all(page == chunk_id * 13 // 7 + 1 for (_, chunk_id), page in got.items())


def test_sentences_by_learned_abbreviations(spark):
    import random

    from vellum.operators import chunk, sentences

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    known = [word() for _ in range(300)]
    plain = lambda n: " ".join(rng.choice(known) for _ in range(n))
    corpus = [(k, " ".join(f"The {plain(6)} Mr. {plain(1).title()} paid approx. 4.5 {plain(3)}, e.g. {plain(2)}. However {plain(4)}." for _ in range(8))) for k in range(60)]
    known_, first = sentences.learn(spark.createDataFrame(corpus, "doc_id long, text string"))
    short = {r.form for r in known_.where("is_abbreviation").collect()}
    assert {"mr", "approx", "e.g"} <= short and not short & set(known)
    assert {"the", "however"} <= {r.form for r in first.collect()}
    texts = [
        (1, "Mr. Rao paid approx. 4.5 percent. The rate, e.g. that of J. Smith, was 3.14 in all. Was it? Yes! it was."),
        (2, "It is the 3. part of it. Page 3. The end"), (3, "He met Mr. However he left."), (4, ""), (5, None), (6, " \n "), (7, "one"),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.sentences for r in sentences.split(docs, known_, first).collect()}
    assert got == {
        1: ["Mr. Rao paid approx. 4.5 percent.", "The rate, e.g. that of J. Smith, was 3.14 in all.", "Was it?", "Yes!", "it was."],
        2: ["It is the 3. part of it.", "Page 3.", "The end"], 3: ["He met Mr.", "However he left."], 7: ["one"],
    }
    chunks = chunk.sentence_chunks(sentences.split(docs, known_, first), size=2, step=2).where("doc_id = 1").orderBy("chunk_id").collect()
    assert [c.n_sentences for c in chunks] == [2, 2, 1]


def test_a_saved_index_finds_the_same(spark, tmp_path):
    import random

    from vellum.sources import vector_index

    rng, path = random.Random(6), str(tmp_path / "index")
    rows = [(f"s{k % 3}", k, [rng.randint(-8, 8) / 2 ** (k % 6) for _ in range(5)]) for k in range(400)] + [("s0", 900, None), ("few", 901, [1.0] * 5), ("few", 902, [0.0] * 5)]
    rows += [("same", 1000 + k, [1.0, 0.0, 0.0, 0.0, 0.0]) for k in range(40)]  # ties across blocks
    queries = [(k, s, [float(rng.randint(-8, 8)) for _ in range(5)]) for k, s in enumerate(["s0", "s1", "s2", "few", "same", "none"] * 4)] + [(99, "same", [0.0] * 5), (100, "s1", None)]
    vectors = spark.createDataFrame(rows, "session_id string, chunk_id long, embedding array<double>")
    vector_index.save(vectors, path, block=8)
    hits, skipped = vector_index.search(spark.createDataFrame(queries, "query_id long, session_id string, query array<double>"), vector_index.load(spark, path), 5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    for q, session, v in queries:
        own = [(c, sum(x * y for x, y in zip(v, e))) for s, c, e in rows if s == session and e is not None] if v else []
        assert got.get(q, []) == sorted(own, key=lambda h: (-h[1], h[0]))[:5]
    told = {r.query_id: (r.blocks, r.blocks_skipped) for r in skipped.collect()}
    assert sum(s for _, s in told.values()) > 0 and all(0 <= s < b for b, s in told.values())


def test_words_are_counted_without_sorting_texts(spark):
    from vellum.operators import sentences

    docs = spark.createDataFrame([(1, "He met Dr. Who. (Then) he left."), (2, "he  ended!"), (3, None), (4, "")], "doc_id long, text string")
    counts, pairs = sentences.forms(docs), sentences.breaks(docs)
    assert {tuple(r) for r in counts.collect()} == {("he", 0, 3), ("met", 0, 1), ("dr", 1, 0), ("who", 1, 0), ("then", 0, 1), ("left", 1, 0), ("ended", 0, 1)}
    assert {tuple(r) for r in pairs.collect()} == {("dr", True, "who", 1), ("who", True, "then", 1)}
    assert "Window" not in pairs._jdf.queryExecution().executedPlan().toString()
