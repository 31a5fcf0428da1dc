"""The pipeline's stages on a small table."""

from pathlib import Path

import pytest

from quirelake.llm import common, pipeline, registry
from quirelake.shared import shared_dir

DIR = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_their_decisions_hold(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    n = docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, DIR), name)
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = pipeline.STAGES[-1][1](spark, docs, DIR)
    assert packed.select("doc_id").distinct().count() == n
    assert [name for name, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "personal_data", "best_fit_packing"]


def left(spark):
    return {p.name.rsplit("-", 1)[0] for p in Path(shared_dir(spark)).iterdir()}, {p.name for p in Path(shared_dir(spark)).iterdir()}


def test_run_leaves_other_queries_tables_alone(spark):
    """Results built before a run can still be read after it, and a scope leaves nothing behind."""
    _, before = left(spark)
    with common.staging(spark):
        lazy = {k: q(spark, DIR) for k, q in registry.QUERIES.items() if k != "pipeline"}
        packed = pipeline.run(spark, DIR)
        assert packed.count() > 0 and packed.columns[:2] == ["doc_id", "piece"]
        assert all(df.count() > 0 for df in lazy.values())
    assert left(spark)[1] == before


def test_a_failed_run_leaves_nothing(spark, monkeypatch):
    def fails(*_):
        raise RuntimeError("stage")

    _, before = left(spark)
    monkeypatch.setattr(pipeline, "STAGES", [*pipeline.STAGES[:1], ("fails", fails), *pipeline.STAGES[2:]])
    with pytest.raises(RuntimeError, match="stage"):
        pipeline.run(spark, DIR)
    assert left(spark)[1] == before


def test_run_alone_leaves_the_pieces_that_its_result_reads(spark):
    _, before = left(spark)
    with common.staging(spark):
        pipeline.run(spark, DIR)
        assert {n.rsplit("-", 1)[0] for n in left(spark)[1] - before} == {"pieces"}


def test_empty_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        docs = common.staged(stage(spark, docs, DIR), name)
        assert docs.count() == 0


def test_the_root_file_gives_the_stages():
    import corpus_pipeline

    assert corpus_pipeline.STAGES is pipeline.STAGES and corpus_pipeline.run is pipeline.run


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_a_query(n):
    assert sum(k.startswith(f"op{n}_") for k in registry.QUERIES) == 1
