"""From OCR responses to reports: files in, records out, against values worked out by hand."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import clean, extract, render, validate
from vellum.sources import ocr


def word(i, text, conf, page=1, hand=False):
    return {"Id": i, "BlockType": "WORD", "Text": text, "Confidence": conf, "Page": page, "TextType": "HANDWRITING" if hand else "PRINTED"}


def line(i, text, page=1):
    return {"Id": i, "BlockType": "LINE", "Text": text, "Page": page}


def child(*ids):
    return {"Type": "CHILD", "Ids": list(ids)}


RESPONSES = {
    "one_raw.json": [line("l1", "First line"), line("l2", "Second"), *[word(f"w{i}", f"t{i}", c) for i, c in enumerate((99.0, 98.5, 97.0, 96.0, 95.0))]],
    "two.json": [line("a", "p1"), word("b", "x", 99.0), word("c", "y", 98.0), line("d", "p2", 2), word("e", "z", 91.0, 2), word("f", "q", 90.0, 2)],
    "hand.json": [line("a", "sign"), word("b", "x", 72.0, hand=True), word("c", "y", 65.0, hand=True)],
    "empty.json": [],
    "words.json": [word("a", "alone", 80.0), {"Id": "z", "BlockType": "MERGED_CELL"}],
    "graph.json": [
        {"Id": "k", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["KEY"], "Confidence": 90.0, "Relationships": [child("w1", "nope", "w2"), {"Type": "VALUE", "Ids": ["v1", "v2", "gone"]}]},
        {"Id": "k2", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["KEY"], "Confidence": 80.0, "Relationships": [child("w5")]},
        {"Id": "k3", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["KEY"], "Confidence": 80.0},
        {"Id": "v1", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["VALUE"], "Confidence": 10.0, "Relationships": [child("w3")]},
        {"Id": "v2", "BlockType": "KEY_VALUE_SET", "EntityTypes": ["VALUE"], "Confidence": 71.0, "Relationships": [child("w3", "w4")]},
        {"Id": "t", "BlockType": "TABLE", "Page": 1, "Relationships": [child("c1", "c2", "c3", "c4", "lost")]},
        {"Id": "t2", "BlockType": "TABLE", "Page": 1},
        {"Id": "c1", "BlockType": "CELL", "RowIndex": 1, "ColumnIndex": 1, "Confidence": 99.0, "Relationships": [child("w1", "w2")]},
        {"Id": "c2", "BlockType": "CELL", "RowIndex": 2, "ColumnIndex": 3, "Relationships": [child("w3")]},
        {"Id": "c3", "BlockType": "CELL", "RowIndex": 2, "ColumnIndex": 3, "Relationships": [child("w4")]},
        {"Id": "c4", "BlockType": "CELL", "Relationships": [child("w5")]},
        word("w1", "Loan", 99.0), word("w2", "Amount", 99.0), word("w3", "7", 99.0), word("w4", "LAKH", 99.0), word("w5", "Branch", 99.0),
    ],
}


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ocr")
    for name, blocks in RESPONSES.items():
        (root / name).write_text(json.dumps({"JobId": "j1", "JobStatus": "SUCCEEDED", "Blocks": blocks}))
    blocks = ocr.blocks(ocr.read_responses(spark, str(root))).cache()
    return blocks, extract.edges(blocks)


def test_pages(parts):
    rows = {(r.session_id, r.page_number): r for r in extract.pages(parts[0]).collect()}
    one = rows["one", 1]
    assert (one.text, one.word_count, one.avg_confidence, one.low_confidence_words, one.has_handwriting) == ("First line\nSecond", 5, 97.1, 0, False)
    assert (rows["two", 1].avg_confidence, rows["two", 2].avg_confidence) == (98.5, 90.5)
    assert (rows["hand", 1].has_handwriting, rows["hand", 1].low_confidence_words, rows["hand", 1].avg_confidence) == (True, 2, 68.5)
    assert (rows["words", 1].text, rows["words", 1].low_confidence_words) == ("", 0)
    assert not [k for k in rows if k[0] == "empty"]


def test_documents_and_tables(parts):
    blocks, edges = parts
    grids = extract.grids(extract.table_cells(blocks, edges))
    docs = {r.session_id: r for r in extract.documents(extract.pages(blocks), grids).collect()}
    assert docs["two"].full_text == "p1\n\n--- Page Break ---\n\np2"
    assert docs["two"].overall_avg_confidence == 94.5
    grid = grids.collect()
    assert len(grid) == 1 and (grid[0].rows, grid[0].cols) == (2, 3)
    assert grid[0].data == [["Loan Amount", "", ""], ["", "", "LAKH"]]
    assert docs["graph"].full_text == "\n\n[TABLE]\nLoan Amount |  | \n |  | LAKH"


def test_form_fields(parts):
    rows = {r.key: r for r in extract.form_fields(*parts).collect()}
    assert set(rows) == {"Loan Amount", "Branch"}
    assert (rows["Loan Amount"].value, rows["Loan Amount"].value_confidence) == ("7 LAKH", 71.0)
    assert (rows["Branch"].value, rows["Branch"].value_confidence) == ("", 0.0)


def test_histogram(parts):
    rows = {r.block_type: r.n_blocks for r in extract.block_histogram(parts[0]).collect()}
    assert rows["TABLE"] == 2 and rows["MERGED_CELL"] == 1


FIELDS = "session_id string, ord long, key string, value string, page int, value_confidence double"


def cleaned(spark, rows):
    df = spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], FIELDS)
    return clean.dedup_fields(clean.clean_fields(df)).orderBy("page", "key")


def test_field_cleaning(spark):
    rows = cleaned(
        spark,
        [
            ("Male", "", 1, 90.0), ("Female", " ", 1, 90.0), ("Loan Amount", "750000", 1, 90.0), ("Net Income", "110 000", 1, 90.0),
            ("Branch", "", 2, 99.0), ("Branch", "INDIRANAGAR", 2, 10.0), ("Date", "15/02/200", 3, 9.0), ("X", "", 1, 1.0), ("X", "", 1, 9.0),
            ("Y", "1", 1, 5.0), ("Y", "2", 1, 6.0), ("Y", "3", 1, 6.0), ("Y", "4", 2, 1.0),
        ],
    ).collect()
    got = {(r.key, r.page): r for r in rows}
    assert ("Male", 1) not in got and ("Female", 1) not in got
    assert (got["Net Income", 1].value, got["Net Income", 1].original_value) == ("110000", "110 000")
    assert got["Branch", 2].value == "INDIRANAGAR" and got["Date", 3].is_truncated
    assert got["X", 1].ord == 7 and got["Y", 1].value == "2" and got["Y", 2].value == "4"
    assert got["Loan Amount", 1].original_value is None


def report(spark, pages, fields, overall=95.0, notes=()):
    docs = spark.createDataFrame([("s", len(pages), overall, any(p[2] for p in pages), list(notes))], "session_id string, total_pages int, overall_avg_confidence double, has_handwriting boolean, cleaning_notes array<string>")
    page = spark.createDataFrame([("s", *p, "text") for p in pages], "session_id string, page_number int, avg_confidence double, has_handwriting boolean, text string")
    return validate.validate(validate.assemble(docs, page, cleaned(spark, fields)))


GOOD = [
    ("First Name", "Asha9", 1, 9.0), ("Last Name", "Rao9", 1, 9.0), ("Loan Amount", "7", 1, 9.0), ("Tenor", "36", 1, 9.0), ("Floating Rate", "5", 1, 9.0),
    ("ECS", "1", 1, 9.0), ("Gross Monthly Income", "5", 1, 9.0), ("Date:", "1/1/2020", 1, 9.0), ("Branch", "12", 1, 9.0), ("PAN Card", "3", 1, 9.0),
]


def codes(df):
    return [i.code for i in df.first().issues]


def test_passing_document(spark):
    row = report(spark, [(1, 95.0, False)], GOOD).first()
    assert row.passed and row.issues == [] and row.required_missing == []
    assert row.summary == "PASS | confidence=95.0% | errors=0 warnings=0 | required_fields=10/10"


@pytest.mark.parametrize(
    "confidence, code",
    [(69.99, ["LOW_OVERALL_CONFIDENCE", "LOW_PAGE_CONFIDENCE"]), (70.0, ["MODERATE_OVERALL_CONFIDENCE", "MODERATE_PAGE_CONFIDENCE"]), (84.99, ["MODERATE_OVERALL_CONFIDENCE", "MODERATE_PAGE_CONFIDENCE"]), (85.0, [])],
)
def test_confidence_bands(spark, confidence, code):
    assert codes(report(spark, [(1, confidence, False)], GOOD, confidence)) == code


def test_issues_in_order(spark):
    df = report(spark, [(1, 60.0, True), (2, 80.0, False)], [("Date:", "15/02/200", 2, 9.0)], 72.0)
    assert codes(df)[:5] == ["MODERATE_OVERALL_CONFIDENCE", "LOW_PAGE_CONFIDENCE", "MODERATE_PAGE_CONFIDENCE", "HANDWRITING_DETECTED", "TRUNCATED_VALUE"]
    assert codes(df)[5:] == ["MISSING_REQUIRED_FIELD"] * 9
    row = df.first()
    assert not row.passed and row.issues[3].message.startswith("Handwriting detected on page(s): [1]. ")
    assert validate.issues(df).count() == 14


def test_nothing_extracted(spark):
    assert codes(report(spark, [], [("Male", "", 1, 1.0)], 0.0)) == ["NO_PAGES", "LOW_OVERALL_CONFIDENCE", *["MISSING_REQUIRED_FIELD"] * 10, "NO_STRUCTURED_DATA"]


def test_markdown(spark):
    df = report(spark, [(1, 95.0, True)], [*GOOD, ("Net", "1 000", 1, 9.0)], notes=["a note"])
    got = render.markdown(df, "2025-01-01 00:00 UTC").first().markdown
    assert got.startswith("# Loan Application — Asha9\n\n**Session:** `s`  \n**Extracted:** 2025-01-01 00:00 UTC  \n**Pages:** 1  \n**Overall Confidence:** 95.0%  \n**Handwriting Detected:** Yes — pages [1]  \n**Validation:** PASS\n\n---\n\n## Cleaning Notes\n\n- a note\n\n---\n\n## Validation Report\n\n- ℹ **HANDWRITING_DETECTED**: ")
    assert "| Applicant First Name | Asha9 |\n" in got and "| 1 | Net | 1000 | normalised from `1 000` |\n" in got
    assert got.endswith("## Full Text\n\n### Page 1 _(contains handwriting)_ — confidence: 95.0%\n\ntext\n")
    missing = render.markdown(report(spark, [(1, 95.0, False)], [("First Name", "", 1, 9.0), ("My First Name", "B1", 2, 9.0)]), "now").first().markdown
    assert missing.startswith("# Loan Application\n") and "| Branch | ⚠ Not found |" in missing and "| 1 | First Name | _empty_ |  |" in missing


def test_repeated_lines_keep_counts(spark):
    df = spark.createDataFrame([(1, "a\nb\na\n a \nc"), (2, ""), (3, "x\nx")], "doc_id long, text string")
    assert [r.text for r in clean.strip_repeated(df).orderBy("doc_id").collect()] == ["b\nc", "", "x\nx"]
    assert [tuple(r) for r in clean.repeated_lines(df).collect()] == [(1, "a", 3)]


def test_gate(spark):
    df = spark.createDataFrame([(1, "loan lender " * 60, "en", 1), (2, "short", "de", 0), (3, "@" * 600, None, 2)], "doc_id long, text string, lang string, page_count int")
    got = {r.doc_id: r for r in clean.gate(df).collect()}
    assert got[1].passed and got[1].errors == [] and got[1].warnings == []
    assert got[2].errors == ["too_short", "no_pages"] and got[2].warnings == ["not_a_loan", "language:de"]
    assert got[3].errors == ["garbled"]


def test_objects(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "x"), ("s2", "y")], "session_id string, text string")
    ocr.write_by_session(rows, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).where("session_id = 's1'")
    assert [r.text for r in back.collect()] == ["x"]
    assert ocr.list_objects(spark, str(tmp_path / "out"), "*.parquet").count() == 2
    got = rows.select(ocr.key("raw_text", F.col("session_id")), ocr.uri("b", ocr.key("chunks", F.col("session_id")))).orderBy("session_id").first()
    assert list(got) == ["extracted/s1/raw_text.txt", "s3://b/chunks/s1/chunks.json"]


def test_batches_of_one_job_are_one_session(spark, tmp_path):
    def save(name, job, status, *blocks, token=None):
        (tmp_path / name).write_text(json.dumps({"JobId": job, "JobStatus": status, "NextToken": token, "Blocks": list(blocks)}))

    save("a_1.json", "j1", "SUCCEEDED", line("l1", "one"), word("w1", "x", 90.0), token="t")
    save("a_2.json", "j1", "SUCCEEDED", line("l2", "two"), word("w2", "y", 80.0))
    save("b.json", "j2", "FAILED", line("l3", "lost"))
    save("b_2.json", "j2", "SUCCEEDED", line("l3", "lost"))
    save("c.json", None, None, line("l4", "alone"))
    responses = ocr.join_batches(ocr.read_responses(spark, str(tmp_path)))
    pages = {r.session_id: r for r in extract.pages(ocr.blocks(responses)).collect()}
    assert set(pages) == {"a_1", "c"} and pages["a_1"].text == "one\ntwo" and pages["a_1"].avg_confidence == 85.0


def test_batches_follow_their_tokens(spark, tmp_path):
    def save(name, job, *blocks, asked=None, token=None):
        (tmp_path / name).write_text(json.dumps({"JobId": job, "JobStatus": "SUCCEEDED", "RequestToken": asked, "NextToken": token, "Blocks": list(blocks)}))

    names = ["q", "c", "z", "a", "m"]
    for k, name in enumerate(names):
        save(f"{name}.json", "j", line(f"l{k}", f"part {k}"), asked=f"t{k}" if k else None, token=f"t{k + 1}" if k < 4 else None)
    save("zz.json", "j", line("l9", "again"), asked="t2", token="t3")  # fetched twice: the first by name counts
    # twelve batches saved without the tokens that they were asked for with, and numbers in their names
    for k in range(1, 13):
        save(f"old_{k}.json", "old", line(f"o{k}", str(k)), token=f"n{k}" if k < 12 else None)
    save("x1.json", "gone", line("g1", "x"), token="p1")
    save("x3.json", "gone", line("g3", "x"), asked="p2")
    save("y1.json", "open", line("h1", "x"), token="p1")
    responses = ocr.join_batches(ocr.read_responses(spark, str(tmp_path)))
    pages = {r.session_id: r.text for r in extract.pages(ocr.blocks(responses)).collect()}
    assert pages == {"q": "\n".join(f"part {k}" for k in range(5)), "old_1": "\n".join(map(str, range(1, 13)))}


def test_order_of_long_broken_and_circular_chains(spark):
    def chain(job, n, skip=(), last=None):
        return [(job, f"{hash((job, k)) % 10**9}-{k}", f"t{k}" if k else None, f"t{k + 1}" if k < n - 1 else last) for k in range(n) if k not in skip]

    rows = chain("long", 700) + chain("hole", 9, skip=(4,)) + chain("headless", 5, skip=(0,)) + chain("open", 3, last="t3") + chain("alone", 1)
    rows += [("ring", "a", None, "x"), ("ring", "b", "y", "z"), ("ring", "c", "z", "y"), ("ring", "d", "x", None)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "job_id string, batch string, request_token string, next_token string")
    got = {(r.job_id, r.batch): (r.batch_no, r.job_state) for r in ocr.batch_order(df).collect()}
    place = lambda batch: int(batch.split("-")[1])
    want = {("ring", x): (n, "cycle") for x, n in (("a", 0), ("d", 1), ("b", None), ("c", None))}
    for job, state in (("long", "whole"), ("hole", "gap"), ("headless", "gap"), ("open", "open"), ("alone", "whole")):
        for j, batch, *_ in rows:
            if j == job:
                reached = job not in ("hole", "headless") or (job == "hole" and place(batch) < 4)
                want[job, batch] = (place(batch) if reached else None, state)
    assert got == want
    assert ocr.batch_order(df.limit(0)).count() == 0


def test_objects_by_key(spark, tmp_path):
    from vellum.sources import objects

    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("s1", "Zinß"), ("s2", None)], "session_id string, content string")
    keyed = rows.select(ocr.key("raw_text", F.col("session_id")).alias("key"), "content")
    assert {(r.key, r.bytes) for r in objects.put(keyed, root).collect()} == {("extracted/s1/raw_text.txt", 5), ("extracted/s2/raw_text.txt", 0)}
    assert [r.text for r in objects.get_text(spark, root, "*.txt").collect()] == ["Zinß"]  # empty objects are passed over
    assert [bytes(r.content) for r in objects.get(spark, root).collect()] == ["Zinß".encode()]
    gone = objects.delete(keyed.union(spark.createDataFrame([("no/such", "")], keyed.schema)), root)
    assert {(r.key, r.deleted) for r in gone.collect()} == {("extracted/s1/raw_text.txt", True), ("extracted/s2/raw_text.txt", True), ("no/such", False)}


def test_objects_with_a_commit(spark, tmp_path):
    from vellum.sources import committed

    root = f"file://{tmp_path}/store"
    assert committed.list_keys(spark, root).count() == 0
    rows = spark.createDataFrame([("extracted/s1/raw_text.txt", "Zinß"), ("extracted/s2/raw_text.txt", None), ("top.txt", "t"), ("a/one.txt", ""), ("a/b/c/d.txt", "deep")], "key string, content string")
    committed.put(rows, root)
    listed = lambda prefix="": {(r.key, r.length) for r in committed.list_keys(spark, root, prefix).collect()}
    there = {("extracted/s1/raw_text.txt", 5), ("extracted/s2/raw_text.txt", 0), ("top.txt", 1), ("a/one.txt", 0), ("a/b/c/d.txt", 4)}
    assert listed() == there and listed("extracted") == {x for x in there if x[0].startswith("extracted/")} and listed("none") == set()
    assert {r.key: bytes(r.content).decode() for r in committed.get(spark, root, "a").collect()} == {"a/one.txt": "", "a/b/c/d.txt": "deep"}
    # a task that fails takes the whole write with it
    bad = spark.range(50).repartition(4).selectExpr("concat('bad/', id) AS key", "if(id = 49, raise_error('lost'), 'x') AS content")
    with pytest.raises(Exception, match="lost"):
        committed.put(bad, root)
    with pytest.raises(Exception, match="no key"):
        committed.put(spark.createDataFrame([("ok.txt", "x"), ("../up.txt", "x")], "key string, content string"), root)
    assert listed() == there and not [p for p in (tmp_path / "store").iterdir() if p.name.startswith(".staged")]
    # a write that was committed and not moved yet, and one that never was
    for name, mark in ((".staged-1", True), (".staged-2", False)):
        (tmp_path / "store" / name / "late").mkdir(parents=True)
        (tmp_path / "store" / name / "late" / "x.txt").write_text(name)
        if mark:
            (tmp_path / "store" / name / ".committed").touch()
    assert listed() == there and committed.publish(spark, root) == 1
    assert listed() == there | {("late/x.txt", 9)} and committed.publish(spark, root) == 0
    committed.put(rows.where("key = 'top.txt'").selectExpr("key", "'new one' AS content"), root)
    assert ("top.txt", 7) in listed()


def test_vectors_are_saved_and_loaded(spark, tmp_path):
    from vellum.sources import objects

    root = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("s1", 2, [3.0, 4.0]), ("s1", 1, [1.0, 2.0]), ("s2", 9, [0.5, 0.25])], "session_id string, chunk_id long, embedding array<float>")
    assert objects.save_vectors(rows, root).count() == 2
    got = sorted((r.session_id, r.row, r.embedding) for r in objects.load_vectors(spark, root).collect())
    assert got == [("s1", 0, [1.0, 2.0]), ("s1", 1, [3.0, 4.0]), ("s2", 0, [0.5, 0.25])]


def test_landed_rows_are_there_until_released(spark):
    import os

    from vellum.sources import workspace

    rows = workspace.landed(spark.range(100).selectExpr("id % 7 AS k", "id"), "k", "some-rows")
    assert rows.groupBy("k").count().count() == 7 and not [t for t in spark.catalog.listTables() if t.name.startswith("some_rows")]
    plan = rows.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    paths = [p.removeprefix("file://") for p in workspace._written]
    assert os.path.isdir(paths[-1])
    workspace.release(spark)
    assert not any(map(os.path.exists, paths)) and not workspace._written


def test_a_cluster_has_to_name_its_shared_folder():
    from vellum.sources import workspace

    class Session:
        conf = {}
        sparkContext = type("Context", (), {"master": "spark://there:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        workspace.shared_path(Session(), "x")


def test_listing_takes_few_tasks(spark, tmp_path):
    from vellum.sources import committed

    root = f"file://{tmp_path}/store"
    rows = spark.range(700).selectExpr("concat('a', id % 3, '/s', id, '/', id, '/x.txt') AS key", "if(id % 5 > 0, 'x', null) AS content")
    committed.put(rows, root)
    assert len(committed.ObjectReader(root, "", False).partitions()) == 4
    listed = committed.list_keys(spark, root)
    assert sorted(map(tuple, listed.collect())) == sorted((f"a{k % 3}/s{k}/{k}/x.txt", int(k % 5 > 0)) for k in range(700))


def test_words_of_pages_are_counted_before_they_are_collected(spark):
    from vellum.operators import extract

    rows = [("a", 1, "LINE", 1, "x y", None, None), ("a", 2, "WORD", 1, "x", "HANDWRITING", 70.0), ("a", 3, "WORD", 1, "y", None, None), ("a", 4, "WORD", None, "z", None, 90.0), ("b", 1, "WORD", 2, "w", "PRINTED", 50.0), ("c", 1, "LINE", 1, None, None, None)]
    blocks = spark.createDataFrame(rows, "session_id string, ord long, block_type string, page int, text string, text_type string, confidence double")
    out = extract.pages(blocks)
    assert sorted(tuple(r) for r in out.collect()) == [("a", 1, "x y", 3, 53.33, 2, True), ("b", 2, "", 1, 50.0, 1, False), ("c", 1, "", 0, 0.0, 0, False)]
    profile = extract.page_profile(blocks)
    assert sorted(tuple(r) for r in profile.collect()) == [("a", 1, 3, 53.3, 1, "x"), ("b", 2, 1, 50.0, 0, "")]
    # words go through hash aggregates, which combine them before they are shuffled, whatever is collected
    for df, name in ((out, "word_count"), (profile, "word_count")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert any("HashAggregate" in x and "ObjectHashAggregate" not in x and "partial_count" in x for x in plan.splitlines()), name


def test_rounds_of_batch_order_move_numbers_only(spark, monkeypatch):
    seen = []
    keep = ocr.settle
    monkeypatch.setattr(ocr, "settle", lambda df, tag: seen.append((tag, dict(df.dtypes))) or keep(df, tag))
    rows = [("j", f"b{k}", f"t{k}" if k else None, f"t{k + 1}" if k < 19 else None) for k in range(20)]
    out = ocr.batch_order(spark.createDataFrame(rows, "job_id string, batch string, request_token string, next_token string"))
    assert sorted((r.batch_no, r.batch, r.job_state) for r in out.collect()) == [(k, f"b{k}", "whole") for k in range(20)]
    rounds = [kinds for tag, kinds in seen if tag == "batch-places"]
    assert len(rounds) > 4 and all("string" not in kinds.values() for kinds in rounds)
