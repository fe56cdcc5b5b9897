"""The pipeline's stages against plain versions on the smallest given tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, path = {}, tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(path / name))
        out[name] = docs = spark.read.parquet(str(path / name))
    return out


def test_columns_stay_until_the_last(spark, stages):
    given = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == given for name, df in stages.items() if name != "tokens")


def test_quality_stage_drops_what_it_rejects(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r.doc_id for r in stages["quality"].collect()} == {r.doc_id for r in judged.where("predicted = 1").collect()}


def test_line_stage_keeps_documents_and_drops_lines(stages):
    before, after = stages["quality"].count(), stages["lines"]
    assert after.count() == before
    every = [x for r in after.collect() for x in (r.text or "").split("\n") if x.strip()]
    assert len(every) == len(set(every))
    assert after.where(F.char_length("text") != F.col("n_chars")).count() == 0


def test_later_stages(spark, stages):
    ids = lambda n: {r.doc_id for r in stages[n].select("doc_id").collect()}
    assert ids("near_copies") <= ids("lines") and ids("leaks") <= ids("near_copies")
    leaks = decontaminate.find_leaks(stages["near_copies"], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids("near_copies") - ids("leaks") == {r.doc_id for r in leaks.collect()}
    assert ids("tokens") == ids("leaks") and stages["tokens"].where("not round_trip").count() == 0
