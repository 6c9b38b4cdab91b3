"""The pipeline's stages in order, each on what the one before it kept."""

import frames

import corpus_pipeline
from test_dedup import brute_firsts
from vellum.llm.common import settle

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = settle(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.count() > 0
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        seen.append(docs.count())
        if name == "near_dedup":
            texts = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(set(brute_firsts(texts)))
    assert seen == sorted(seen, reverse=True)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count() and out.where("n_tokens > 0").count() > 0


def test_stages_bear_odd_rows(spark):
    docs = frames.documents(spark, extra=frames.CLASH)
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SF), name)
    assert docs.count() > 0


def test_the_mix_reaches_the_result(spark):
    from vellum.llm import mixing

    # as many files as ranges of slots, of sizes in no order
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        kept = settle(corpus_pipeline.target_mix(spark, docs, SF), "mixing")
        slots = {r.doc_id: r.slot for r in mixing.mix(docs).select("doc_id", "slot").collect()}
        out = corpus_pipeline.encoded(spark, kept, SF)
        assert out.columns == ["doc_id", "n_tokens", "token_ids"] and len(kept.inputFiles()) > 2
        ids = [r.doc_id for r in out.collect()]
        assert ids == sorted(slots, key=lambda i: (slots[i], i)) and len(ids) == docs.count()
        written = settle(out, "encoded")
        assert {(r.doc_id, r.token_ids) for r in written.collect()} == {(r.doc_id, r.token_ids) for r in bpe_of(kept)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def bpe_of(docs):
    from vellum.llm import bpe
    from vellum.llm.queries import vocabulary

    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json")).collect()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "token_ids"]


def test_written_steps_can_be_released(spark):
    import os

    from vellum.llm.common import _written, release

    settle(spark.range(3), "gone")
    path = _written[-1].removeprefix("file://")
    assert os.path.isdir(path)
    release(spark)
    assert not os.path.exists(path) and not _written


def test_scratch_keeps_what_was_there_before(spark, monkeypatch):
    import os

    from vellum.llm import common

    before = common.settle(spark.range(3), "before")
    kept = common.settled(spark, lambda: common.settle(spark.range(5), "inner"), "result")
    paths = [p.removeprefix("file://") for p in common._written]
    assert not any("/inner-" in p for p in paths) and all(map(os.path.isdir, paths))
    assert before.count() == 3 and kept.count() == 5
    common.release(spark)


def test_a_cluster_has_to_name_its_shared_folder():
    import pytest

    from vellum.llm import common

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://there:7077"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
