"""References in block graphs: resolved without shuffling blocks, for sessions cut by batches and for odd ids."""

import pyarrow as pa

from vellum.operators import extract, graph
from vellum.plans import catalog

SF = "/root/testdata/sf0.001"
BLOCKS = "session_id string, ord long, id string, block_type string, page int, text string, confidence double, entity_types array<string>, row_index int, col_index int"
EDGES = "session_id string, src string, rtype string, rpos int, ipos int, dst string"


def shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), plan.count("BroadcastExchange")


def test_only_fields_are_shuffled(spark):
    assert shuffles(catalog.QUERIES["form_graph"](spark, SF)) == (1, 0)
    assert shuffles(catalog.QUERIES["table_cells"](spark, SF)) == (1, 0)


def whole(sizes, cuts):
    """The sessions of each batch that ``whole_sessions`` gives for sessions of ``sizes`` parts, dealt in batches of ``cuts`` rows."""
    rows = [(s, n) for s, n in enumerate(sizes) for _ in range(n)]
    batches, at = [], 0
    for c in cuts:
        own = rows[at : at + c]
        at += c
        batches.append(pa.RecordBatch.from_pydict({"s": pa.array([r[0] for r in own], pa.int64()), "n_parts": pa.array([r[1] for r in own], pa.int64())}))
    assert at == len(rows)
    return [b["s"].to_pylist() for b in graph.whole_sessions(iter(batches))]


def test_whole_sessions():
    assert whole([2, 3], [5]) == [[0, 0, 1, 1, 1]]
    assert whole([2, 3, 1], [1, 1, 2, 2]) == [[0, 0], [1, 1, 1, 2]]
    assert whole([7], [2, 2, 0, 2, 1]) == [[0] * 7]
    assert whole([1, 6, 1], [3, 3, 2]) == [[0], [1] * 6 + [2]]
    assert whole([1, 4, 2], [3, 2, 2]) == [[0], [1] * 4, [2, 2]]
    assert whole([], [0]) == []


def test_sessions_over_many_batches(spark):
    """Ids are a session's own; a missing id, a null one and words of no text join nothing; what comes twice is taken twice."""
    blocks, edges = [], []
    for s in ("a", "b", "c"):
        blocks += [
            (s, 1, "k", "KEY_VALUE_SET", None, None, None, ["KEY"], None, None), (s, 2, "v", "KEY_VALUE_SET", 1, None, 7.0, ["VALUE"], None, None),
            (s, 3, "w", "WORD", 1, "key " + s, 1.0, None, None, None), (s, 4, "x", "WORD", 1, None, 1.0, None, None, None),
            (s, 5, "y", "WORD", 1, s, 1.0, None, None, None), (s, 6, "y", "WORD", 1, "A", 1.0, None, None, None),
            (s, 7, None, "WORD", 1, "nothing", 1.0, None, None, None), (s, 8, "e", "KEY_VALUE_SET", 1, "", 1.0, None, None, None),
        ]
        edges += [
            (s, "k", "CHILD", 0, 0, "w"), (s, "k", "VALUE", 1, 1, "v"), (s, "k", "VALUE", 1, 0, "e"), (s, "k", "VALUE", 1, 2, "gone"), (s, "k", "VALUE", 1, 3, None),
            (s, "v", "CHILD", 0, 1, "y"), (s, "v", "CHILD", 0, 0, "x"), (s, None, "CHILD", 0, 0, "w"), (s, "v", None, 0, 0, "w"),
        ]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        own = extract.form_fields(spark.createDataFrame(blocks, BLOCKS), spark.createDataFrame(edges, EDGES)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, own)) == [(s, 1, "key " + s, "A " + s, 0.0, 7.0, 1) for s in "abc"]
