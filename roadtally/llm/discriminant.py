"""Quality classifier: regularised quadratic discriminant.

A text becomes ten statistics (lengths, shares of symbols, capitals, repeats), logarithms of ratios
mostly, standardised by the training rows. Each class has a mean and a covariance shrunk towards
its diagonal and the pooled one; the score is the logistic of the difference of Gaussian log
densities plus the log prior, with Cholesky factors made once. Spark sums the statistics' moments
over all labelled training rows, so fitting needs no sample.

Defined results: a null text counts as an empty one and is scored; ids with several label rows take
the largest label, null labels are left out; without both classes every score is the smoothed share of label 1; an empty
table gives no rows; repeated rows each get their row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadtally.llm.common import written
from roadtally.llm.quality_rules import measured

DIM = 10
SHRINK = 0.15


def statistics(text: str | None) -> list[float]:
    n, chars, symbols, dup, repeat, lines, upper, letters, run, short = measured(text)
    ratio = lambda a, b: np.log((a + 0.5) / (b + 1.0))
    return [
        np.log1p(n),
        chars / (n + 1.0),
        ratio(symbols, n),
        ratio(dup, lines),
        ratio(repeat, n),
        ratio(upper, letters),
        ratio(chars - letters, chars),
        ratio(run, n),
        ratio(n, lines),
        ratio(short, lines),
    ]


def statistics_of(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(statistics(t)) for t in texts], dtype=object)

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "array<double>").asNondeterministic()(text)


@dataclass
class Discriminant:
    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    log_prior: float
    share: float

    @staticmethod
    def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK) -> Discriminant:
        """moments: label -> (rows, sums, sums of products)."""
        n0, n1 = (moments[k][0] if k in moments else 0 for k in (0, 1))
        share = (n1 + 1) / (n0 + n1 + 2)
        if not n0 or not n1:
            return Discriminant(np.zeros(DIM), np.ones(DIM), [], [], [], 0.0, share)
        total = n0 + n1
        center = (moments[0][1] + moments[1][1]) / total
        products = (moments[0][2] + moments[1][2]) / total - np.outer(center, center)
        scale = np.sqrt(np.maximum(np.diag(products), 1e-9))
        means, covariances = [], []
        for k in (0, 1):
            n, s, ss = moments[k]
            mean = s / n
            covariances.append((ss / n - np.outer(mean, mean)) / np.outer(scale, scale))
            means.append((mean - center) / scale)
        pooled = (n0 * covariances[0] + n1 * covariances[1]) / total
        factors, dets = [], []
        for k, n in ((0, n0), (1, n1)):
            trust = n / (n + 5.0 * DIM)  # few rows lean on the pooled covariance
            c = trust * covariances[k] + (1 - trust) * pooled
            c = (1 - shrink) * c + shrink * np.diag(np.diag(c)) + 1e-3 * np.eye(DIM)
            factor = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(factor))
            dets.append(2 * float(np.log(np.diag(factor)).sum()))
        return Discriminant(center, scale, means, factors, dets, float(np.log(n1 / n0)), share)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), self.share)
        z = (x - self.center) / self.scale
        log = [-0.5 * ((((z - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.log_prior, -500, 500)))


def label_table(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): the largest label of each id."""
    return labels.where(F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))


def score_quality(docs: DataFrame, labels: DataFrame, in_training: Column, column: str = "quality", shrink: float = SHRINK) -> DataFrame:
    """doc_id, score and predicted of each row; learns from labelled rows where in_training holds."""
    table = docs.select(F.col("doc_id").cast("long"), statistics_of(F.col("text").cast("string")).alias("x"), in_training.alias("fit"))
    table = written(table, "statistics")
    train = table.where("fit").join(label_table(labels, column), "doc_id")
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(DIM)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"p{i}_{j}") for i in range(DIM) for j in range(i + 1)]
    moments = {}
    for r in train.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect():  # two rows
        p = np.array([[r[f"p{max(i, j)}_{min(i, j)}"] for j in range(DIM)] for i in range(DIM)])
        moments[int(r["label"] > 0)] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(DIM)]), p)
    model = Discriminant.fit(moments, shrink)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.stack(x.to_numpy())) if len(x) else [], dtype="float64")

    scored = table.select("doc_id", score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
