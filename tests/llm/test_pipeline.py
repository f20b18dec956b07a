"""The pipeline: what each stage keeps, and that the whole runs."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from turnwise.llm import jaccard
from turnwise.llm.common import stored

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), "test"))
    return out


def test_stages_keep_the_columns_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0


def test_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1")
    good = stages[0].join(labels, "doc_id").filter(F.size(F.split("text", r"\s+")) >= 30)
    lost = good.join(stages[1], "doc_id", "left_anti").count()
    assert lost <= 0.05 * good.count()


def test_everything_kept_is_packed(stages):
    packed = stages[-1].groupBy("doc_id").agg(F.sum("piece_length").alias("n"))
    words = stages[-2].select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    assert words.join(packed, "doc_id").filter("n = w").count() == stages[-2].count()


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


def test_passages_do_not_join_documents_in_stage_two(spark, monkeypatch):
    """A chain of passages runs through 100 texts: what is first laid out for comparison stays in proportion to them."""

    class Enough(Exception):
        pass

    def counted(tasks):
        def run(groups):
            raise Enough(tasks(groups).count())

        return run

    for name in ("_tasks", "_apart"):
        if hasattr(jaccard, name):
            monkeypatch.setattr(jaccard, name, counted(getattr(jaccard, name)))
    monkeypatch.setattr(jaccard, "BLOCK", 10)
    passage = lambda i: " ".join(f"p{i}-{'long' * 5}-{k}" for k in range(7))
    own = lambda i: " ".join(f"w{i}-{k}" for k in range(60))
    rows = [(i, f"{passage(i)} {own(i)} {passage(i + 1)}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with pytest.raises(Enough) as seen:
        corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert seen.value.args[0] <= 200
