"""Numeric kernels: vector expressions, and p-values as Arrow functions."""

from __future__ import annotations

import gzip
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str) -> Column:
    """Divided by the norm; a zero vector stays zero."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def distance(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """One less the cosine; null if either vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def softmax(values: Column | str) -> Column:
    """Exponentials of an array, shifted by its maximum, over their sum."""
    raised = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))


def stars(p: Column, tests: Column | int) -> Column:
    """Marks of significance after Bonferroni's correction for a number of tests: *** below 0.001, ** 0.01, * 0.05."""
    corrected = p * tests
    return F.when(corrected < 0.001, "***").when(corrected < 0.01, "**").when(corrected < 0.05, "*").otherwise("")


@F.pandas_udf(T.DoubleType())
def gzip_ratio(texts: pd.Series) -> pd.Series:
    """Compressed size over size in UTF-8; 0 for empty or null."""
    raw = [(t or "").encode("utf-8") for t in texts]
    return pd.Series([len(gzip.compress(b)) / len(b) if b else 0.0 for b in raw], dtype="float64")


def _choose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric_tail(k: int, total: int, marked: int, drawn: int) -> float:
    """P(X >= k) for ``drawn`` of ``total`` with ``marked`` among them, by summing logarithms."""
    low, high = max(k, 0, drawn - (total - marked)), min(marked, drawn)
    if k <= max(0, drawn - (total - marked)):
        return 1.0
    if low > high:
        return 0.0
    terms = [_choose(marked, i) + _choose(total - marked, drawn - i) - _choose(total, drawn) for i in range(low, high + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


@F.pandas_udf(T.DoubleType())
def hypergeometric_p(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([hypergeometric_tail(*map(int, x)) for x in zip(k, total, marked, drawn)], dtype="float64")


def rank_test_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided Mann-Whitney p: exact for at most 8 on one side without ties, else normal with continuity.

    ``ties`` is the sum of t**3 - t over groups of equal values.
    """
    if min(n1, n2) == 0:
        return float("nan")
    if min(n1, n2) <= 8 and ties == 0:
        ways = np.zeros((n1 + 1, n1 * n2 + 1))
        ways[0, 0] = 1
        # subsets of ranks: adding the j-th value to the first sample beats j - 1 minus those before it
        for j in range(1, n1 + n2 + 1):
            for i in range(min(j, n1), 0, -1):
                gain = j - i
                if gain <= n2:
                    ways[i, gain:] += ways[i - 1, : ways.shape[1] - gain]
        counts = ways[n1]
        top = int(round(max(u, n1 * n2 - u)))
        return float(min(1.0, 2 * counts[top:].sum() / counts.sum()))
    n = n1 + n2
    spread = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if spread <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(spread)
    return float(min(1.0, math.erfc(max(z, 0) / math.sqrt(2))))


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_test_p(a, int(b), int(c), d) for a, b, c, d in zip(u, n1, n2, ties)], dtype="float64")
