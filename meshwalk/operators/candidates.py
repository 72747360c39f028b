"""Candidate tables: grids, random points, walkers, schedules, simplexes."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.functions.rng import uniform
from meshwalk.functions.shared import cut


def grid_points(spark: SparkSession, mins: list[float], maxs: list[float], nums: list[int]) -> DataFrame:
    """(id, x): the full product of evenly spaced axes. In two dimensions the first axis runs fastest; in more, the last
    runs fastest, then down to the third, then the first, and the second slowest. One point on an axis is its minimum."""
    d = len(nums)
    order = list(range(d)) if d <= 2 else [1, 0, *range(2, d)][::-1]  # fastest first
    place, stride = [None] * d, 1
    for k in order:
        step = (maxs[k] - mins[k]) / (nums[k] - 1) if nums[k] > 1 else 0.0
        i = F.floor(F.col("id") / F.lit(stride)) % nums[k]
        place[k] = F.when(i == max(nums[k] - 1, 1), F.lit(float(maxs[k]))).otherwise(F.lit(float(mins[k])) + i * F.lit(step))
        stride *= nums[k]
    return spark.range(stride).select("id", F.array(*place).alias("x"))


def random_points(spark: SparkSession, mins: list[float], maxs: list[float], n: int, seed: int = 0) -> DataFrame:
    return spark.range(n).select("id", F.array(*[F.lit(float(a)) + F.lit(float(b - a)) * uniform(seed, F.col("id"), k) for k, (a, b) in enumerate(zip(mins, maxs, strict=True))]).alias("x"))


def init_walkers(spark: SparkSession, mins: list[float], maxs: list[float], n: int, allowed=None, initial: DataFrame | None = None, seed: int = 0, max_tries: int = 100) -> DataFrame:
    """(walker, x): the rows of ``initial`` (walker, x); if they are fewer than n, all are judged and those missing or not
    ``allowed`` (a function of a column, of built-in functions) are drawn anew until they are.

    A walker is drawn where its row is, its draws being functions of seed, walker and round, and only as many as it needs: one
    job, whatever the number of rounds. A walker without an allowed point after ``max_tries`` draws is an error."""
    if initial is not None and initial.count() >= n:
        return initial.where(F.col("walker") < n)
    ok = allowed or (lambda x: F.lit(True))

    def draw(found: Column, r: Column) -> Column:
        x = F.array(*[F.lit(float(a)) + F.lit(float(b - a)) * uniform(seed, F.col("walker"), r, k) for k, (a, b) in enumerate(zip(mins, maxs, strict=True))])
        return F.when(found["ok"], found).otherwise(F.struct(x.alias("x"), F.coalesce(ok(x), F.lit(False)).alias("ok")))

    none = F.struct(F.lit(None).cast("array<double>").alias("x"), F.lit(False).alias("ok"))
    walkers = spark.range(n).select(F.col("id").alias("walker"))
    if initial is None:
        walkers = walkers.withColumn("start", F.lit(None).cast("array<double>"))
    else:
        walkers = walkers.join(initial.where(ok(F.col("x"))).select("walker", F.col("x").alias("start")), "walker", "full")
    found = F.aggregate(F.sequence(F.lit(0), F.lit(max_tries - 1)), none, draw)
    found = F.when(F.col("start").isNotNull(), F.struct(F.col("start").alias("x"), F.lit(True).alias("ok"))).otherwise(found)
    done = cut(walkers.withColumn("found", found).select("walker", F.when(F.col("found.ok"), F.col("found.x")).alias("x")), "walkers")
    if not done.where("x IS NULL").isEmpty():
        raise RuntimeError(f"some walkers are not allowed after {max_tries} rounds")
    return done


def temperature_schedule(spark: SparkSession, n: int, tmin=None, tmax=None, bmin=None, bmax=None, log: bool = True) -> DataFrame:
    """(t_index, beta, temp), even in the given quantity or its logarithm; temperatures go down from beta 0 on as given."""
    by_t = tmin is not None and tmax is not None
    if by_t == (bmin is not None and bmax is not None):
        raise ValueError("give either temperatures or inverse temperatures")
    a, b = (tmin, tmax) if by_t else (bmin, bmax)
    if a > b:
        raise ValueError("the minimum is above the maximum")
    if log and a <= 0:
        raise ValueError("a logarithmic range must begin above 0")
    f = F.col("id") / F.lit(float(max(n - 1, 1)))
    v = F.pow(F.lit(10.0), F.lit(math.log10(a)) + f * F.lit(math.log10(b) - math.log10(a))) if log else F.lit(float(a)) + f * F.lit(float(b - a))
    beta, temp = (1 / v, v) if by_t else (v, F.when(v != 0, 1 / v).otherwise(F.lit(float("inf"))))
    return spark.range(n).select(F.col("id").cast("int").alias("t_index"), beta.alias("beta"), temp.alias("temp"))


def annealing_plan(numsteps: int = 0, steps_per_t: int = 0, n_t: int = 0) -> list[int]:
    """Steps of each temperature from two of the three; what is left over goes to the first temperatures."""
    if sum(v > 0 for v in (numsteps, steps_per_t, n_t)) != 2:
        raise ValueError("give exactly two of numsteps, steps_per_t and n_t")
    if not numsteps:
        return [steps_per_t] * n_t
    if not n_t:
        n_t = max(1, numsteps // steps_per_t)
    each, rest = divmod(numsteps, n_t)
    return [each + (k < rest) for k in range(n_t)]


def initial_simplex(starts: DataFrame, scales: list[float]) -> DataFrame:
    """(id, vertex, x): each start and, for each axis k, the start moved by scales[k] along it."""
    moved = F.transform("x", lambda v, i: v + F.when(i + 1 == F.col("vertex"), F.element_at(F.array(*map(F.lit, map(float, scales))), i + 1)).otherwise(0.0))
    return starts.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.size("x")))).select("id", "vertex", moved.alias("x"))


def satisfies(x: Column, a: list[list[float]], b: list[float]) -> Column:
    """Every row of a x + b is strictly above 0."""
    out = F.lit(True)
    for row, c in zip(a, b, strict=True):
        out = out & (_linear(x, row, c) > 0)
    return out


def _linear(x: Column, row: list[float], c: float) -> Column:
    """row . x + c, added in this order; coordinates with coefficient 0 are left out, so an infinite one does no harm."""
    terms = [x[k] if v == 1 else F.lit(float(v)) * x[k] for k, v in enumerate(row) if v]
    out = functools.reduce(lambda p, q: p + q, terms) if terms else F.lit(0.0)
    return out + F.lit(float(c)) if c or not terms else out


def affine(x: Column, a: list[list[float]] | None, b: list[float] | None, dim: int | None = None) -> Column:
    """a x + b; without a the identity on ``dim`` coordinates, without b no shift."""
    rows = a or [[float(i == k) for k in range(dim or len(b))] for i in range(dim or len(b))]
    return F.array(*[_linear(x, row, b[i] if b else 0.0) for i, row in enumerate(rows)])


def in_box(x: Column, mins: list[float], maxs: list[float], strict: bool = False) -> Column:
    out = F.lit(True)
    for k, (a, b) in enumerate(zip(mins, maxs, strict=True)):
        out = out & ((x[k] > a) & (x[k] < b) if strict else (x[k] >= a) & (x[k] <= b))
    return out


def evaluate(df: DataFrame, objective, mapping=None, allowed=None, ignore_error: bool = False) -> DataFrame:
    """Adds fx: infinity where x, before mapping, is not allowed; else the objective of the mapped x. ``objective`` is a
    function of columns, or one of arrays in :func:`user_objective`; an error in it ends the job, or with ``ignore_error``
    gives NaN to its row (functions of arrays, wrapped here; those of columns give null instead of an error, hence NaN)."""
    x = F.col("x")
    fx = objective(mapping(x) if mapping else x)
    if ignore_error:
        fx = F.coalesce(fx, F.lit(float("nan")))
    return df.withColumn("fx", F.when(allowed(x), fx).otherwise(F.lit(float("inf"))) if allowed else fx)


def user_objective(fn, ignore_error: bool = False):
    """Column function from ``fn``, which gets a batch of points as an n by d matrix and returns n values. With
    ``ignore_error`` a batch that fails is tried row by row, and failing rows get NaN."""
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy())
        try:
            return pd.Series(np.asarray(fn(m), float))
        except Exception:
            if not ignore_error:
                raise
        out = np.full(len(m), np.nan)
        for k in range(len(m)):
            try:
                out[k] = np.asarray(fn(m[k : k + 1]), float)[0]
            except Exception:
                continue
        return pd.Series(out)

    return run


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Adds z_<col>, a_<col> and s_<col>: (value - mean) / population standard deviation of all rows; 0 for a constant column."""
    m = df.agg(*[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    z = lambda c: F.when(F.col(f"s_{c}") > 0, F.try_divide(F.col(c) - F.col(f"a_{c}"), F.col(f"s_{c}"))).otherwise(0.0)
    return df.join(F.broadcast(m)).withColumns({f"z_{c}": z(c) for c in cols})  # one row


def unstandardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """The inverse: <col> from z_<col>, a_<col> and s_<col>."""
    return df.withColumns({c: F.col(f"z_{c}") * F.col(f"s_{c}") + F.col(f"a_{c}") for c in cols})


def train_test_split(df: DataFrame, u: Column, key: str, train: float, test: float) -> DataFrame:
    """(key, part): the rows of the smallest u are train, the next ones test, in the given shares of the rows, rounded down.
    Both cuts are order statistics of (u, key), found without numbering the rows."""
    p = df.select(key, u.alias("u"))
    n = p.count()
    a, b = int(n * train), int(n * train) + int(n * test)
    low = p.orderBy("u", key).limit(b)
    first = low.orderBy("u", key).limit(a).select(key, F.lit("train").alias("part"))
    return first.unionByName(low.join(first.select(key), key, "left_anti").select(key, F.lit("test").alias("part")))


def design_matrix(df: DataFrame, x: str, degree: int) -> DataFrame:
    """Adds p0 ... p<degree>: the powers of x."""
    return df.withColumns({f"p{k}": F.pow(x, F.lit(float(k))) if k else F.lit(1.0) for k in range(degree + 1)})
