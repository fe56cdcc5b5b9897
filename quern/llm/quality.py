"""Quality classifier: regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics of its bytes and words.
Spark adds up, over all labelled rows, each class's count, sum and sum of outer
products, so what reaches the driver is two small matrices however many labels
there are. A class's covariance is shrunk towards the pooled covariance and its
diagonal; its Cholesky factor is kept in the model. The score is the logistic of
the difference of the two classes' log densities (Mahalanobis distance and log
determinant) and log priors.

Defined cases: null text counts as empty; every text has a vector, so every row
has a score; a null doc_id counts as not held out; repeated labels of a document
count once (the larger one); null labels are left out; without rows of both
classes the score is the share of label 1, and 0.5 without labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

FEATURES = ("words", "word_length", "upper", "digits", "spaces", "lines", "stops", "marks", "pipes", "symbols", "wide", "unique", "repeated", "letters")
THRESHOLD = 0.3
#: Weights of the pooled covariance and of its diagonal in a class's covariance.
TO_POOLED, TO_DIAGONAL = 0.1, 0.1
_SYMBOLS = [ord(c) for c in "#$%&*@^~=<>{}[]\\/_+`"]
_TINY = 1e-3
#: Words (six times as many bytes) of a usual text that each share is mixed with, so short texts are not extreme.
WEIGHT = 20


def vector(text: str) -> list[float]:
    """The transformed statistics of a text."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    count = np.bincount(data, minlength=256)
    words = text.split()
    n, size = len(words), max(1, len(data))
    lower, upper = int(count[97:123].sum()), int(count[65:91].sum())
    wide = int(count[128:].sum())
    letters = upper + lower
    share = lambda part, whole, usual, weight=WEIGHT: float(np.log((part + weight * usual) / (whole + weight) + _TINY))
    return [
        float(np.log1p(n)),
        float(np.log((size - int(count[32]) - int(count[10]) + 5 * WEIGHT) / (n + WEIGHT))),
        share(upper, letters, 0.04, 6 * WEIGHT),
        share(int(count[48:58].sum()), size, 0.002, 6 * WEIGHT),
        share(int(count[32]), size, 0.16, 6 * WEIGHT),
        share(int(count[10]), n, 0.03),
        share(int(count[46] + count[44] + count[59] + count[58]), n, 0.15),
        share(int(count[33] + count[63]), n, 0.0),
        share(int(count[124]), n, 0.0),
        share(int(count[_SYMBOLS].sum()), n, 0.0),
        share(wide, size, 0.01, 6 * WEIGHT),
        share(len(set(words)), n, 0.8),
        share(sum(map(eq, words, words[1:])), n, 0.0),
        share(letters + wide, size, 0.8, 6 * WEIGHT),
    ]


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``vector``, an array of doubles, per row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("vector", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            made = pa.array([vector(t or "") for t in (x.as_py() for x in batch.column(text))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([batch.column(c) for c in keep] + [made], arrow, strict=True)], schema=arrow)

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Model:
    """Per class: log prior, mean, Cholesky factor of the covariance and its log determinant."""

    prior: tuple[float, float]
    classes: tuple[tuple[np.ndarray, np.ndarray, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior[1])
        log = []
        for p, (mean, root, determinant) in zip(self.prior, self.classes, strict=True):
            z = np.linalg.solve(root, (x - mean).T)
            log.append(np.log(p) - 0.5 * (z * z).sum(axis=0) - 0.5 * determinant)
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def sums(rows: DataFrame, label: str = "label") -> DataFrame:
    """Per class: how many rows, the sum of their vectors and of their outer products."""
    d = len(FEATURES)

    def run(batches):
        totals = {}
        for batch in batches:
            x = np.array(batch.column("vector").to_pylist(), float).reshape(-1, d)
            y = np.array(batch.column(label).to_pylist())
            for k in (0, 1):
                z = x[y == k]
                n, s, ss = totals.get(k, (0, 0, 0))
                totals[k] = (n + len(z), s + z.sum(axis=0), ss + z.T @ z)
        cells = [(k, i, float(v)) for k, (n, s, ss) in totals.items() for i, v in enumerate([n, *np.atleast_1d(s), *np.ravel(ss)])]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()), pa.array([c[2] for c in cells], pa.float64())], names=["k", "i", "v"])

    return rows.select("vector", F.col(label).cast("int").alias(label)).mapInArrow(run, "k int, i int, v double").groupBy("k", "i").agg(F.sum("v").alias("v"))


def fit(rows: DataFrame, label: str = "label", to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Model:
    """The model of all rows (vector, label 0 or 1); what is collected has a fixed size."""
    d = len(FEATURES)
    cells = np.zeros((2, 1 + d + d * d))
    for r in sums(rows.where(F.col(label).isin(0, 1)), label).collect():
        cells[r["k"], r["i"]] = r["v"]
    n = cells[:, 0]
    if n.sum() == 0:
        return Model((0.5, 0.5), ())
    if n.min() < 2:
        return Model((n[0] / n.sum(), n[1] / n.sum()), ())
    means = cells[:, 1 : d + 1] / n[:, None]
    scatter = cells[:, d + 1 :].reshape(2, d, d) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    classes = []
    for mean, own in zip(means, scatter / n[:, None, None], strict=True):
        cov = (1 - to_pooled) * own + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
        root = np.linalg.cholesky(cov)
        classes.append((mean, root, 2 * float(np.log(np.diag(root)).sum())))
    return Model((n[0] / n.sum(), n[1] / n.sum()), tuple(classes))


def apply(vectors: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``vectors`` with ``score`` and ``predicted`` in place of the vector."""

    @F.pandas_udf(T.DoubleType())
    def scored(column):
        import pandas as pd

        return pd.Series(model.score(np.stack(column.to_numpy())) if len(column) else [], dtype=float)

    return vectors.withColumn("score", scored("vector")).drop("vector").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``documents``; learnt from the
    labelled rows that are not held out."""
    vectors = durable(features(documents))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    model = fit(vectors.where(~held_out()).join(known, "doc_id"))
    return apply(vectors, model, threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
