"""Quality classifier: regularised quadratic discriminant (operator 2).

A document becomes ``FEATURES``, statistics of its whole text on scales that are roughly normal
within a class. Each class has a mean and a covariance, shrunk towards the pooled covariance and
that towards its diagonal. The score is the probability of class 1 by Bayes' rule from the
difference of the two log densities, each a Mahalanobis distance by a cached Cholesky factor.

Labels, language, source and doc_id are no features. Labels are learnt from the rows outside
the held-out fold only. A null text counts as empty and an empty text is scored like any other.
Null labels are left out; a document with several labels counts for each; repeated rows are
scored each. With fewer than two documents of either class the score is the share of class 1
among the labels, 0.5 without labels. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.tables import BATCH_ROWS
from landspan.workspace import materialize

FEATURES = (
    "size", "words", "word_length", "upper", "digits", "marks", "bars", "other_marks", "spaces",
    "new_words", "top_word", "same_next", "new_lines", "line_length", "non_ascii",
)
# Shares of the pooled covariance in a class's, and of the diagonal in the pooled one.
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
# Added to standardised variances.
RIDGE = 1e-3
FOLDS, HELD_OUT = 3, 1

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = b"#$%&*@^~=+<>_!"
_OTHER = b",.;:?'\"()[]{}-/\\"
_SPACES = b" \t\n\r\x0b\x0c"
_ASCII = bytes(range(128))


def features(text: str) -> tuple[float, ...]:
    """Statistics of one text, in the order of FEATURES."""
    data = text.encode("utf-8", "replace")
    size = len(data)
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x]
    share = lambda chars: (size - len(data.translate(None, chars))) / (size + 1)
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    logit = lambda p: math.log((p + 0.002) / (1.002 - p))
    return (
        math.log(size + 1), math.log(n + 1), math.log((size + 1) / (n + 1)),
        logit(share(_UPPER)), logit(share(_DIGITS)), logit(share(_MARKS)), logit(share(b"|")),
        logit(share(_OTHER)), logit(share(_SPACES)),
        math.log((len(counts) + 1) / (n + 1)), logit(max(counts.values(), default=0) / (n + 1)),
        logit(same / (n + 1)), math.log((len(set(lines)) + 1) / (len(lines) + 1)),
        math.log((size + 1) / (len(lines) + 1)),
        logit((size - share(_ASCII) * (size + 1)) / (size + 1)),
    )


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of its text, one row a document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(begin, BATCH_ROWS)
                table = np.array([features(x) for x in part.column(1).to_pylist()], float)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *map(pa.array, table.reshape(-1, len(FEATURES)).T)],
                    names=["doc_id", *FEATURES])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{name} double" for name in FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")),
                  F.lit(FOLDS)) == HELD_OUT


class Discriminant:
    """Two normal densities over standardised features and the classes' shares."""

    def __init__(self, counts: list[float], sums: list[np.ndarray], products: list[np.ndarray]):
        self.share = counts[1] / sum(counts) if sum(counts) else 0.5
        self.fitted = min(counts) >= 2
        if not self.fitted:
            return
        total = sum(counts)
        center = (sums[0] + sums[1]) / total
        means = [s / n for s, n in zip(sums, counts, strict=True)]
        inner = [p / n - np.outer(m, m) for p, n, m in zip(products, counts, means, strict=True)]
        pooled = (counts[0] * inner[0] + counts[1] * inner[1]) / total
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.center, self.scale = center, scale
        pooled = pooled / np.outer(scale, scale)
        pooled = (1 - TO_DIAGONAL) * pooled + TO_DIAGONAL * np.diag(np.diag(pooled))
        self.means, self.inverse, self.constant = [], [], []
        for mean, own, n in zip(means, inner, counts, strict=True):
            mixed = (1 - TO_POOLED) * own / np.outer(scale, scale) + TO_POOLED * pooled
            factor = np.linalg.cholesky(mixed + RIDGE * np.eye(len(scale)))
            self.means.append((mean - center) / scale)
            self.inverse.append(np.linalg.inv(factor))
            self.constant.append(math.log(n / total) - np.log(np.diag(factor)).sum())

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row of features."""
        if not self.fitted:
            return np.full(len(rows), self.share)
        z = (rows - self.center) / self.scale
        density = [c - 0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1)
                   for c, m, inv in zip(self.constant, self.means, self.inverse, strict=True)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(labelled: DataFrame) -> Discriminant:
    """Discriminant of rows (quality, features); Spark adds up counts, sums and products."""
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    found = {r["quality"]: r for r in labelled.where("quality in (0, 1)").groupBy("quality").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(FEATURES)],
        *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()}
    counts, sums, products = [], [], []
    for label in (0, 1):
        row = found.get(label)
        counts.append(float(row["n"]) if row else 0.0)
        sums.append(np.array([row[f"s{i}"] if row else 0.0 for i in range(d)]))
        product = np.zeros((d, d))
        for i, j in pairs if row else []:
            product[i, j] = product[j, i] = row[f"p{i}_{j}"]
        products.append(product)
    return Discriminant(counts, sums, products)


def fit_documents(found: DataFrame, labels: DataFrame) -> Discriminant:
    """Discriminant of the labelled documents outside the held-out fold.

    found: document_features of all documents.
    """
    known = labels.select("doc_id", "quality").where(~held_out(F.col("doc_id")))
    return fit(found.dropDuplicates(["doc_id"]).join(known, "doc_id"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents whose score is 0.5 or more, with all their columns."""
    model = fit_documents(materialize(document_features(docs), "quality-features"), labels)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        out = []
        for begin in range(0, len(texts), BATCH_ROWS):
            part = texts.slice(begin, BATCH_ROWS).to_pylist()
            out.extend((model.score(np.array([features(x) for x in part])) >= 0.5).tolist())
        return pa.array(out, pa.bool_())

    return docs.where(good(F.coalesce("text", F.lit(""))))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document row."""
    found = materialize(document_features(docs), "quality-features")
    model = fit_documents(found, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(rows))], names=["doc_id", "score"])

    return found.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_quality_score(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/labels.parquet"))
