"""Reports of sessions: parts that meet in one row are as those that meet by grouping."""

from pyspark.sql import functions as F

from vellum.operators import clean, extract
from vellum.plans import catalog
from vellum.sources import workspace

SF = "/root/testdata/sf0.001"
NAN = float("nan")


def test_a_report_takes_one_shuffle_and_writes_nothing(spark):
    before = list(workspace._written)
    plan = catalog.QUERIES["markdown_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert workspace._written == before
    assert plan.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" not in plan and plan.count("Window [") == 1


def test_fields_in_a_row_are_those_by_grouping(spark):
    rows = [
        (s, i, key, value, page, confidence)
        for s in ("a", "b", None)
        for i, (key, value, page, confidence) in enumerate(
            [
                ("X", "", 1, 9.0), ("X", "1", 1, None), ("X", "2", 1, 5.0), ("X", "3", 1, NAN), ("X", "4", 1, NAN), ("Y", "1", 1, 5.0), ("Y", "2", 1, 5.0), ("Y", None, 1, 9.0),
                ("Z", None, 2, 9.0), ("Z", "", 2, 1.0), ("Z", "", 2, 3.0), (None, "7", 2, 1.0), (None, "8", 2, 2.0), ("W", "15 000.", None, -1.0), ("W", "36MONTHS", None, -2.0),
                ("V", "1", 3, None), ("V", "2", 3, None), ("V", "3", 4, -0.0), ("V", "4", 4, 0.0), ("Male", " ", 1, 1.0), ("Male", "x", 2, 1.0), (" Yes ", "", 1, 1.0),
            ]
        )
    ]
    own = clean.tidied(spark.createDataFrame(rows, "session_id string, ord long, key string, value string, page int, value_confidence double"))
    names = ("page", "key", "value", "confidence", "is_truncated", "original_value")
    want = clean.dedup_fields(own.where("NOT is_box").drop("is_box")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("f"))
    got = own.select("session_id", clean.field_part().alias("p")).groupBy("session_id").agg(F.collect_list("p").alias("p")).select("session_id", clean.dedup_parts(F.col("p")).alias("f"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() == 3


def test_cells_and_words_in_a_row(spark):
    cells = [
        ("a", 2, 1, 1, 1, 5, "late"), ("a", 2, 1, 1, 1, 4, "early"), ("a", 2, 1, 3, 2, 1, "end"), ("a", 2, 1, 0, 1, 1, "above"), ("a", 2, 1, 1, 0, 1, "beside"),
        ("a", 1, 1, 1, 1, 1, None), ("a", 1, 2, 0, 3, 1, "none"), ("b", 1, 1, 2, 1, 1, "x"), ("b", 1, 1, 1, 2, 1, "y"),
    ]
    df = spark.createDataFrame(cells, "session_id string, table_ord int, page int, row int, col int, pos long, text string")
    want = {
        ("a", 2, 1, 3, 2): [["late", ""], ["", ""], ["", "end"]], ("a", 1, 1, 1, 1): [[""]], ("a", 1, 2, 0, 3): [], ("b", 1, 1, 2, 2): [["", "y"], ["x", ""]],
    }
    together = df.groupBy("session_id").agg(F.collect_list(F.struct(*df.columns[1:])).alias("c")).select("session_id", F.inline(extract.grids_in(F.col("c"))))
    for got in (extract.grids(df), together):
        assert {(r.session_id, r.table_ord, r.page, r.rows, r.cols): r.data for r in got.collect()} == want

    words = [(2, 0.1, False), (1, 90.005, False), (2, 0.2, True), (1, None, False), (2, 1e-12, False), (3, None, False)]
    df = spark.createDataFrame([(words,)], "w array<struct<page_number:int,confidence:double,has_handwriting:boolean>>")
    pages = df.select(extract.pages_in(F.col("w")).alias("p")).first().p
    assert [tuple(p) for p in pages] == [(1, 2, 45.0, False), (2, 3, 0.1, True), (3, 1, None, False)]
    assert df.select(extract.pages_in(F.array().cast("array<struct<page_number:int,confidence:double,has_handwriting:boolean>>")).alias("p")).first().p == []
