"""Toxicity: held-out accuracy, unseen spellings, and odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from turnwise.llm import toxicity, words
from turnwise.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"  # the smaller tables hold a few dozen toxic documents
INSULTS = ["idiot", "moron", "worthless", "pathetic", "disgusting"]


def auc(p, y):
    rank = np.argsort(np.argsort(p))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()


def made(rng, toxic, n):
    syllables = ["ka", "lo", "ne", "ti", "ru", "sa", "mi", "vo"]
    w = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    if toxic:
        for _ in range(max(1, n // 60)):
            w[rng.randrange(n)] = rng.choice(INSULTS)
    return " ".join(w)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    labels = [int(rng.random() < 0.4) for _ in range(400)]
    return toxicity.fit([made(rng, t, rng.randint(3, 300)) for t in labels], labels)


def of(model, *texts):
    return toxicity.scores(pa.array([t.lower() for t in texts], pa.large_string()), model)


def test_documents_of_any_length_and_unseen_spellings(model):
    rng = random.Random(2)
    for n in (1, 5, 100, 5_000):
        y = np.array([0, 1] * 20)
        p = of(model, *(made(rng, t, n) for t in y))
        assert (p[y == 1] >= 0.7).mean() >= 0.95 and (p[y == 0] < 0.7).mean() >= 0.95
    plain = made(rng, 0, 20)
    for word in ("idiots", "MORON!", "worthles", "pathetically", "disgustin"):
        assert of(model, f"{plain} {word} {plain}")[0] > 0.5, word
    assert of(model, plain)[0] < 0.3


def test_one_insult_in_a_very_long_text(model):
    rng = random.Random(3)
    clean = made(rng, 0, 200_000)
    assert of(model, clean + " worthless idiot " + clean)[0] >= 0.7


def test_subwords_are_the_framed_grams():
    two = words.split_words(pa.array(["ab xyz ab"], pa.large_string()))
    grams, offsets = toxicity.subwords(two, np.array([0, 1, 2]))
    assert np.diff(offsets).tolist() == [3, 6, 3]  # <ab ab> <ab>; <xy xyz yz> <xyz xyz> <xyz>
    assert grams[:3].tolist() == grams[9:].tolist()
    assert len(set(grams[:9].tolist())) == 9


def test_held_out_rows(spark):
    scored = QUERIES["op13_subword_toxicity"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").filter("toxic IS NOT NULL")
    rows = scored.collect()
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    unlearned = "crc32(CAST(doc_id AS STRING)) % 3 = 1"
    assert {r.doc_id for r in rows if r.held_out} == {r.doc_id for r in docs.filter(unlearned).collect()}
    judged = scored.filter("held_out").join(labels, "doc_id").collect()
    p, y = np.array([r.score for r in judged]), np.array([r.toxic for r in judged])
    assert auc(p, y) > 0.95  # some documents of the tables are toxic by a word or two that none of the others holds
    assert (p[y == 1] >= 0.7).mean() > 0.75 and (p[y == 0] >= 0.7).mean() < 0.02


def test_odd_rows_and_missing_labels(spark):
    rng = random.Random(4)
    rows = [(i, made(rng, i % 2, 50), i % 2) for i in range(60)]
    odd = [(100, None, None), (101, "", 1), (102, " \n", None), (None, "you idiot", None), (None, "you idiot", None), (3, "twice", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, mark int").withColumn("score", F.lit("x"))
    docs = df.drop("mark").withColumn("toxic", F.lit("y"))
    labels = df.select("doc_id", F.col("mark").alias("toxic"), F.lit(1).alias("text"))
    labels = labels.union(labels.filter("doc_id = 5")).union(spark.createDataFrame([(7, 9, 1), (8, None, 1)], labels.schema))
    got = toxicity.score(docs, labels, F.lit(True)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(r[0]) for r in rows + odd)
    empty = {r.score for r in got if r.doc_id in (100, 101, 102)}
    assert len(empty) == 1 and 0 <= empty.pop() < 0.7
    assert len({r.score for r in got if r.doc_id is None}) == 1
    for some in (labels.limit(0), labels.filter("toxic = 0")):
        assert {r.score for r in toxicity.score(docs, some, F.lit(True)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels, F.lit(True)).count() == 0
