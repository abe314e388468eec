"""Distances and kernels of two array columns, as expressions inside the JVM."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators.matrix import dot

EPS = 2.0**-52


def _fold(x, y, fn):
    return F.aggregate(F.zip_with(x, y, fn), F.lit(0.0), lambda s, v: s + v)


def _same_length(x, y, value):
    return F.when(F.size(x) == F.size(y), value).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double"))


def sqeuclidean(x, y):
    return _same_length(x, y, _fold(x, y, lambda a, b: (a - b) * (a - b)))


def euclidean(x, y):
    return F.sqrt(sqeuclidean(x, y))


def manhattan(x, y):
    return _same_length(x, y, _fold(x, y, lambda a, b: F.abs(a - b)))


def minkowski(x, y, p: float):
    if p <= 0:
        raise ValueError("the Minkowski power must be positive")
    if p == 2:
        return euclidean(x, y)
    if p == 1:
        return manhattan(x, y)
    return _same_length(x, y, F.pow(_fold(x, y, lambda a, b: F.pow(F.abs(a - b), F.lit(float(p)))), F.lit(1.0 / p)))


def norm(x):
    return F.sqrt(dot(x, x))


def cosine(x, y):
    """1 - cosine; a norm of 0 counts as 1, so the distance to a zero vector is 1."""
    safe = lambda n: F.when(n <= EPS, F.lit(1.0)).otherwise(n)
    return _same_length(x, y, F.lit(1.0) - dot(x, y) / (safe(norm(x)) * safe(norm(y))))


def inner_product(x, y):
    return _same_length(x, y, dot(x, y))


METRICS = {
    "euclidean": euclidean, "l2": euclidean, "euclidean_gemm": euclidean, "sqeuclidean": sqeuclidean, "sqeuclidean_gemm": sqeuclidean,
    "manhattan": manhattan, "l1": manhattan, "cityblock": manhattan, "cosine": cosine, "inner product": inner_product,
}


def distance(metric: str, x, y, p: float = 2.0):
    if metric == "minkowski":
        return minkowski(x, y, p)
    if metric not in METRICS:
        raise ValueError(f"metric must be minkowski or one of {', '.join(METRICS)}")
    return METRICS[metric](x, y)


def rbf(x, y, gamma: float = 1.0):
    return F.exp(F.lit(-float(gamma)) * sqeuclidean(x, y))


def linear(x, y):
    return inner_product(x, y)


def polynomial(x, y, degree: int = 3, gamma: float = 1.0, coef0: float = 1.0):
    return F.pow(F.lit(float(gamma)) * inner_product(x, y) + F.lit(float(coef0)), F.lit(float(degree)))


def sigmoid(x, y, gamma: float = 1.0, coef0: float = 1.0):
    return F.tanh(F.lit(float(gamma)) * inner_product(x, y) + F.lit(float(coef0)))


KERNELS = {"rbf": rbf, "linear": linear, "polynomial": polynomial, "poly": polynomial, "sigmoid": sigmoid}


def normalize(x):
    """The row at unit length; a zero row stays."""
    n = norm(x)
    return F.transform(x, lambda v: v / F.when(n == 0, F.lit(1.0)).otherwise(n))
