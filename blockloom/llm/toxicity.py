"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the text's features and the probabilities of the
categories before it. For training these probabilities are out of fold: each row gets them from models fitted without
it, as the models behind would otherwise learn to trust values that are too good.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from blockloom.llm import common

WORD = re.compile(r"[^\W\d_]+")
#: Word starts stand for a word's family, so that a form not seen in training still counts.
STARTS = (4, 5)
CANDIDATES = 16_384
FEATURES = 256
LEAST_DOCS = 3
SAMPLE_ROWS = 16_384
FOLDS = 4
RIDGE = 0.3
THRESHOLD = 0.5
#: The chain. The last category is the given label; the others are graded from it: a labelled document with at
#: least three marker words, and one in which a fiftieth of the different words are markers.
CATEGORIES = ("repeated", "dense", "toxic")
MARKER_RATE = 0.9


def features(text: str) -> set[str]:
    """Different words in small letters, and their starts marked by a star."""
    words = set(WORD.findall(text.lower()))
    return words.union(*[{word[:n] + "*" for word in words if len(word) > n} for n in STARTS])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Weights and intercept of a ridge logistic model by Newton's method; only an intercept if there is one class."""
    weights = np.zeros(x.shape[1] + 1)
    if not len(y) or y.min() == y.max():
        weights[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -30
        return weights
    full = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(len(weights), ridge)
    penalty[-1] = 1e-3
    for _ in range(15):
        p = sigmoid(full @ weights)
        step = np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full + np.diag(penalty), full.T @ (p - y) + penalty * weights)
        weights -= step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass
class Chain:
    vocabulary: dict[str, int]
    models: list[np.ndarray]

    def probabilities(self, sets: list[set[str]]) -> np.ndarray:
        """One row for each feature set, one column for each category."""
        x = np.zeros((len(sets), len(self.vocabulary)))
        known = self.vocabulary.keys()
        for row, found in enumerate(sets):
            x[row, [self.vocabulary[f] for f in known & found]] = 1
        return self.run(x)

    def run(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), 0))
        for weights in self.models:
            out = np.hstack([out, sigmoid(np.hstack([x, out]) @ weights[:-1] + weights[-1])[:, None]])
        return out


def train_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> list[np.ndarray]:
    """A model for each column of ``labels``, fitted behind the out-of-fold probabilities of the columns before it."""
    models, before = [], np.empty((len(x), 0))
    for category in range(labels.shape[1]):
        inputs, y = np.hstack([x, before]), labels[:, category]
        models.append(fit(inputs, y))
        unseen = np.zeros(len(x))
        for fold in np.unique(folds):
            out = folds == fold
            weights = fit(inputs[~out], y[~out])
            unseen[out] = sigmoid(inputs[out] @ weights[:-1] + weights[-1])
        before = np.hstack([before, unseen[:, None]])
    return models


def _counts(rows: DataFrame, known: set[str] | None) -> DataFrame:
    """Rows that hold a feature, by feature; each task adds up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in common.text_of(batch):
                found = features(text)
                counts.update(found if known is None else known & found)
            if len(counts) > 500_000:
                yield _pairs(counts)
                counts.clear()
        if counts:
            yield _pairs(counts)

    return common.few_rows(rows).select("text").mapInArrow(run, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def _pairs(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])


def select_features(rows: DataFrame, total: int, toxic: int, count: int = FEATURES) -> tuple[list[str], list[str]]:
    """Features that tell the classes apart best (likelihood ratio over the sample), and the marker words among them."""
    top = (_counts(rows.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCS)
           .orderBy(F.desc("n"), "feature").limit(CANDIDATES))
    with_toxic = {row["feature"]: row["n"] for row in top.collect()}
    known = set(with_toxic)
    clean_counts = {row["feature"]: row["n"] for row in _counts(rows.where("toxic = 0"), known).collect()} if known else {}
    clean, scored = total - toxic, []
    for feature, a in with_toxic.items():
        b = clean_counts.get(feature, 0)
        if a * clean <= b * toxic:  # more frequent in clean rows
            continue
        cells = np.array([a, b, toxic - a, clean - b], float)
        expected = np.array([toxic, clean, toxic, clean]) * np.repeat([(a + b) / total, 1 - (a + b) / total], 2)
        scored.append((float((cells * np.log(np.maximum(cells, 1e-9) / np.maximum(expected, 1e-9))).sum()), feature, a / (a + b)))
    scored.sort(key=lambda s: (-s[0], s[1]))
    chosen = scored[:count]
    return [f for _, f, _ in chosen], [f for _, f, rate in chosen if rate >= MARKER_RATE and not f.endswith("*")]


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """hash, text, toxic of about ``rows`` labelled documents (all, if there are no more): those with the smallest hash of their id.

    Labels of one id are joined to the worst, a null label is none; of several texts of one id the first in order counts. The bound on
    the labels is what allows them to be broadcast, so no text is shuffled but the sample's.
    """
    given = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = given.withColumn("hash", F.xxhash64("doc_id"))
    total = given.count()
    if total > rows:
        given = given.where(F.col("hash") <= int(2 ** 64 * rows / total) - 2 ** 63)
    found = docs.select("doc_id", "text").join(F.broadcast(given), "doc_id")
    return found.groupBy("doc_id").agg(F.first("hash").alias("hash"), F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Chain:
    """Fit the chain on a bounded sample of labelled documents.

    Without a toxic label every document gets a probability near 0. The driver holds at most 16,384 candidate features and
    the sample's features.
    """
    rows = common.staged(labelled_sample(docs, labels, sample_rows), "labelled")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    chosen, markers = select_features(rows, size["n"], size["toxic"]) if size["toxic"] else ([], [])
    vocabulary = {feature: i for i, feature in enumerate(chosen)}
    marked = {vocabulary[f] for f in markers}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, words = [], []
            for text in common.text_of(batch):
                own = features(text)
                found.append(sorted(vocabulary[f] for f in vocabulary.keys() & own))
                words.append(sum(not f.endswith("*") for f in own))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("toxic").cast(pa.int32()), pa.array(words, pa.int32()),
                                              pa.array(found, pa.list_(pa.int32()))], names=["hash", "toxic", "words", "found"])

    drawn = sorted(common.few_rows(rows).mapInArrow(run, "hash long, toxic int, words int, found array<int>").collect())
    x, grades = np.zeros((len(drawn), len(chosen))), np.zeros((len(drawn), len(CATEGORIES)))
    for i, row in enumerate(drawn):
        x[i, row["found"]] = 1
        hits = len(marked.intersection(row["found"]))
        grades[i] = row["toxic"] and hits >= 3, row["toxic"] and 50 * hits >= row["words"] and hits > 0, row["toxic"]
    models = train_chain(x, grades, np.array([row["hash"] % FOLDS for row in drawn]))
    common.remove(rows)
    return Chain(vocabulary, models)


def score(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, a probability for each category of the chain, and toxic (last probability at least ``threshold``) for every row.

    Whole texts count; a null or empty text has no features and gets the intercepts' probabilities; repeated rows stay;
    other columns are not read; an empty table gives an empty one. No shuffle.
    """
    names = ["doc_id", *[f"p_{c}" for c in CATEGORIES], "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches):
            p = chain.probabilities([features(text) for text in common.text_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(np.round(column, 6)) for column in p.T],
                                              pa.array(p[:, -1] >= threshold)], names=names)

    return common.few_rows(docs).select("doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'p_{c} double' for c in CATEGORIES)}, toxic boolean")


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, all columns."""
    chain = train(docs, labels)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        out = []
        for start in range(0, len(texts), 128):
            found = [features(text or "") for text in texts.slice(start, 128).to_pylist()]
            out.append(chain.probabilities(found)[:, -1] >= threshold)
        return pa.array(np.concatenate(out) if out else np.empty(0, bool))

    return common.few_rows(docs).where(~toxic(docs["text"]))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
