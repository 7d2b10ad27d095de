"""The chain learns from out-of-fold probabilities and does well on held-out documents."""

import numpy as np
from pyspark.sql import functions as F

from blockloom.llm import common, toxicity
from tests.llm.helpers import ROWS, clashing, documents

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = common.table(spark, SF_DIR, "documents"), common.table(spark, SF_DIR, "labels")
    chain = toxicity.train(docs, labels.where("doc_id % 2 = 1"))
    scored = toxicity.score(docs, chain).withColumnRenamed("toxic", "found").join(labels.where("doc_id % 2 = 0"), "doc_id")
    counts = {(r["found"], r["toxic"]): r["count"] for r in scored.groupBy("found", "toxic").count().collect()}
    hit, missed, false = counts.get((True, 1), 0), counts.get((False, 1), 0), counts.get((True, 0), 0)
    assert hit / (hit + missed) >= 0.8 and false / (hit + false) <= 0.05


def test_out_of_fold_inputs():
    """A category that copies noise is of no use to the next one: out-of-fold values show it, in-fold ones would not."""
    draw = np.random.default_rng(1)
    x, noise = draw.random((400, 30)).round(), draw.random(400).round()
    models = toxicity.train_chain(x, np.stack([noise, x[:, 0]], 1), np.arange(400) % 4)
    assert len(models) == 2 and len(models[1]) == 32
    assert abs(models[1][30]) < 1 < models[1][0]
    p = toxicity.Chain({str(i): i for i in range(30)}, models).run(x)
    assert ((p[:, 1] > 0.5) == (x[:, 0] > 0.5)).mean() > 0.97


def test_awkward_rows(spark):
    rows = ROWS + [(100 + i, f"plain text number {i} of these", "en", "a", 1) for i in range(20)] + [(200 + i, f"you nasty thing {i}", "en", "a", 1) for i in range(20)]
    docs = clashing(documents(spark, rows))
    labels = spark.createDataFrame([(100 + i, 0) for i in range(20)] + [(200 + i, 1) for i in range(20)] + [(2, 0), (None, 1), (5, None), (200, 0)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert scored.count() == len(rows)
    assert {r["doc_id"] for r in scored.where("toxic").collect()} == {200 + i for i in range(20)}
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 20


def test_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = documents(spark)
    assert toxicity.clean(docs, labels).count() == len(ROWS)
    clean_only = docs.select("doc_id", F.lit(0).alias("toxic"))
    assert toxicity.score(docs, toxicity.train(docs, clean_only)).where("toxic").count() == 0
    assert toxicity.clean(documents(spark, []), labels).count() == 0


def test_sample_is_bounded_and_repeated_ids_count_once(spark):
    docs = documents(spark, [(i % 300, f"text {i % 300}", "en", "a", 1) for i in range(900)])
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    assert toxicity.labelled_sample(docs, labels).count() == 300
    assert 60 <= toxicity.labelled_sample(docs, labels, 100).count() <= 140
