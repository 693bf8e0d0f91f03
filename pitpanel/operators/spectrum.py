"""The covariance spectrum of the columns of a table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The sample covariance of the columns, over rows that have them all: two aggregates, whose result is columns squared."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    v = VectorAssembler(inputCols=list(columns), outputCol="v").transform(rows).select("v")
    s = v.select(Summarizer.metrics("variance", "count").summary(F.col("v")).alias("s")).select("s.variance", "s.count").first()
    if not s or s["count"] < 2:
        raise ValueError("a covariance needs two rows or more")
    sd = np.sqrt(np.maximum(s["variance"].toArray(), 0))
    found = np.nan_to_num(Correlation.corr(v, "v").first()[0].toArray())  # a column without spread has none
    np.fill_diagonal(found, 1.0)
    return found * np.outer(sd, sd)


def spectrum(cov: np.ndarray, *, correlation: bool = False, top: int = 5) -> dict:
    """participation, entropy_rank, shares (of the `top` largest eigenvalues), top_share (their sum) and leading.

    participation: squared sum of the eigenvalues over the sum of their squares; entropy_rank: exp of the entropy of
    their shares; leading: the first eigenvector, turned so that its sum is not negative. With correlation, columns
    are scaled to variance one first, and one without spread is an error.
    """
    if correlation:
        var = np.diag(cov)
        if (var <= 0).any():
            raise ValueError("a column has no spread")
        cov = cov / np.sqrt(np.outer(var, var))
        np.fill_diagonal(cov, 1.0)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    total = values.sum()
    if total <= 0:
        raise ValueError("no column has spread")
    shares = values / total
    some = shares[shares > 0]
    lead = vectors[:, 0] * (-1 if vectors[:, 0].sum() < 0 else 1)
    return {
        "participation": float(total**2 / (values**2).sum()),
        "entropy_rank": float(np.exp(-(some * np.log(some)).sum())),
        "shares": [float(x) for x in shares[:top]],
        "top_share": float(shares[:top].sum()),
        "leading": [float(x) for x in lead],
    }


def effective_rank(df: DataFrame, columns: Sequence[str], *, correlation: bool = False, top: int = 5) -> DataFrame:
    """One row: participation, entropy_rank, top_share doubles, shares and leading arrays of double (by column)."""
    s = spectrum(covariance(df, columns), correlation=correlation, top=top)
    kind = "participation double, entropy_rank double, top_share double, shares array<double>, leading array<double>"
    return df.sparkSession.createDataFrame([(s["participation"], s["entropy_rank"], s["top_share"], s["shares"], s["leading"])], kind)
