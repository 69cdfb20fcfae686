"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text becomes a vector of transformed statistics (logarithms of counts, square roots of
smoothed shares). For each class the mean and covariance come from moments that the executors sum
over all labelled training rows. A class's covariance is shrunk towards the diagonal of the
pooled one. Its Cholesky factor is inverted once and kept; a score is the logistic of the
difference of the two classes' log densities (Mahalanobis distances and determinants) and priors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, narrowed, slices, stored

SHRINKAGE, RIDGE = 0.1, 1e-3
ACCEPT = 0.3
HELD_OUT = 5

UPPER = bytes(range(0x41, 0x5B))
DIGITS = bytes(range(0x30, 0x3A))
PLAIN = b".,;:'\"-?()"
SYMBOLS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b not in PLAIN)
PUNCTUATION = SYMBOLS + PLAIN
NAMES = ("words", "word_length", "upper", "symbols", "bare", "types", "repeats", "top_word", "repeated_lines", "digits", "line_length", "sentences")


def statistics(text: str | None) -> list[float]:
    """The vector of a text, in the order of NAMES; null counts as empty."""
    text = text or ""
    raw = text.encode()
    words = text.split()
    n, size, lines = len(words), len(raw), text.split("\n")
    counts = Counter(words)
    without = lambda some: size - len(raw.translate(None, some))
    share = lambda k, of, prior: ((k + prior) / (of + prior * 50)) ** 0.5  # noqa: E731  a prior share of 2 %
    return [
        float(np.log(n + 20)),
        float(np.log((size + 7 * 10) / (n + 10))),
        share(without(UPPER), size, 4),
        share(without(SYMBOLS), size, 0.2),
        share(n - len(raw.translate(None, PUNCTUATION).split()), n, 0.1),
        float(np.log(len(counts) + 10) / np.log(n + 10)),
        share(sum(map(eq, words, words[1:])), n, 0.1),
        share(max(counts.values(), default=0), n, 3),
        share(len(lines) - len(set(lines)), len(lines), 0.1),
        share(without(DIGITS), size, 0.2),
        float(np.log((size + 300) / (len(lines) + 3))),
        share(raw.count(b". ") + raw.count(b".\n") + raw.endswith(b"."), n, 2),
    ]


@dataclass(frozen=True)
class Model:
    """For class 0 and 1: mean, inverse of the Cholesky factor, and what is added to the log density."""

    means: np.ndarray
    whiten: np.ndarray
    offsets: np.ndarray

    @classmethod
    def fitted(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrinkage: float = SHRINKAGE) -> Model | None:
        """From each class's row count, sum and sum of outer products. None if a class has under two rows."""
        if n.min() < 2:
            return None
        means = sums / n[:, None]
        scatter = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
        pooled = np.diag(np.maximum(np.einsum("c,cii->i", n / n.sum(), scatter), RIDGE**2))
        whiten, offsets = [], []
        for c in (0, 1):
            factor = np.linalg.cholesky((1 - shrinkage) * scatter[c] + (shrinkage + RIDGE) * pooled)
            whiten.append(np.linalg.inv(factor))
            offsets.append(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum())
        return cls(means, np.array(whiten), np.array(offsets))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row."""
        z = np.einsum("cij,ncj->nci", self.whiten, x[:, None, :] - self.means[None])
        density = self.offsets - 0.5 * (z**2).sum(axis=2)
        return 1 / (1 + np.exp(np.clip(density[:, 0] - density[:, 1], -500, 500)))


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics, of every row."""
    docs = narrowed(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = pa.array([statistics(t.as_py()) for t in part.column(1)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), x], names=["doc_id", "x"])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def fit(found: DataFrame, labels: DataFrame) -> Model | None:
    """The model of vectors(documents) and labels (doc_id, quality), from all rows that aren't held
    out. Labels other than 0 and 1 and null ids are left out; a repeated label counts as often."""
    labels = narrowed(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    rows = found.join(labels, "doc_id").select("quality", "x")
    d = len(NAMES)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            y = batch.column(0).to_numpy()
            x = np.asarray(batch.column(1).flatten()).reshape(-1, d)
            for c in (0, 1):
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()), pa.array(total.ravel())], names=["class", "at", "value"])

    sums = map_batches(rows, moments, "class int, at int, value double").groupBy("class", "at").agg(F.sum("value").alias("value"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # as many rows as the moments have numbers
        total[r["class"], r["at"]] = r["value"]
    return Model.fitted(total[:, 0], total[:, 1 : d + 1], total[:, d + 1 :].reshape(2, d, d))


def scored(found: DataFrame, model: Model | None) -> DataFrame:
    """vectors(documents) with score. Without a model (a class has no examples) every score is 0.5."""
    shared = found.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(NAMES))
            score = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return map_batches(found, run, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every row of docs.

    Null and empty texts are scored as the vector of an empty text, texts of any length whole; repeated
    rows get equal scores; a null id isn't held out. Empty tables work: without documents the result is empty, without labels
    of both kinds every score is 0.5. Other columns are ignored.
    """
    found = stored(vectors(docs), "vectors")
    found = scored(found, fit(found, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns of docs, whatever their names. The
    texts are read twice and shuffled never.

    Null and empty texts are judged as an empty text; texts of any length are judged whole; rows with
    equal texts stay or go together, null ids are like others. Without labels of both kinds all stay; an
    empty table stays empty.
    """
    model = fit(vectors(docs), labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = np.array([statistics(t.as_py()) for t in part.column(at)])
                keep = shared.value.score(x) >= ACCEPT if shared.value else np.ones(len(x), bool)
                yield part.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score and decision of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels)
