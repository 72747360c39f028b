"""Test objectives as Column expressions over x array<double>."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six points of the linear-regression objective.
LINREG_X = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
LINREG_Y = [1.0, 3.0, 2.0, 4.0, 3.0, 5.0]


def total(x: Column, f) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + f(v))


def quadratics(x: Column) -> Column:
    return total(x, lambda v: v * v)


def quartics(x: Column) -> Column:
    n = F.size(x)
    return total(x, lambda v: (v - 1) * (v - 1)) / n * (total(x, lambda v: (v + 1) * (v + 1)) / n)


def ackley(x: Column) -> Column:
    mean = total(x, lambda v: v * v) / F.size(x)
    return 20 + math.e - 20 * F.exp(-0.2 * F.sqrt(mean)) - F.exp(0.5 * total(x, lambda v: F.cos(2 * math.pi * v)))


def rosenbrock(x: Column) -> Column:
    n = F.size(x)
    pairs = F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: 100 * (b - a * a) * (b - a * a) + (1 - a) * (1 - a))
    return total(pairs, lambda v: v)


def himmelblau(x: Column, shift: float = 0.0) -> Column:
    """At (x[0], x[1] + shift); the shift is added where x[1] + shift stands in the formula, from left to right."""
    a, b = x[0], x[1]
    p, q = a * a + b, b
    if shift:
        p, q = p + shift, b + shift
    p, q = p - 11, a + q * q - 7
    return F.when(F.size(x) == 2, p * p + q * q).otherwise(F.raise_error(F.lit("two coordinates are needed")))


def linreg_nll(x: Column, xs=LINREG_X, ys=LINREG_Y) -> Column:
    res = sum(((x[0] * p + x[1] - q) * (x[0] * p + x[1] - q) for p, q in zip(xs, ys, strict=True)), F.lit(0.0))
    return 0.5 * (len(xs) * x[2] + res / F.exp(x[2]))


def quadratics_array(x: np.ndarray) -> np.ndarray:
    """The same over the rows of a matrix, for tasks that move points themselves."""
    return (x * x).sum(axis=1)


def rosenbrock_array(x: np.ndarray) -> np.ndarray:
    return (100 * (x[:, 1:] - x[:, :-1] ** 2) ** 2 + (1 - x[:, :-1]) ** 2).sum(axis=1)


def himmelblau_array(x: np.ndarray) -> np.ndarray:
    a, b = x[:, 0], x[:, 1]
    return (a * a + b - 11) ** 2 + (a + b * b - 7) ** 2
