"""Resampling of a varied population: large means are not cut."""

import math

import numpy as np
from pyspark.sql import functions as F

from meshwalk.operators import population as pop


def test_poisson_of_large_means(spark):
    for lam in (300.0, 499.5, 501.0, 2_000.25, 1_000_000.0):
        rows = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u")).select(pop.poisson(F.lit(lam), F.col("u")).alias("n"))
        n = np.array([r.n for r in rows.collect()], float)
        # evenly spread uniforms: mean and spread are those of the distribution, but for its furthest tails
        assert abs(n.mean() - lam) < 0.1 * math.sqrt(lam) and abs(n.std() / math.sqrt(lam) - 1) < 0.03
    got = spark.sql("SELECT 3.0D AS lam, explode(array(0.0D, 0.2D, 0.5D, 0.99D, 1 - pow(2, -52))) AS u UNION ALL SELECT 0.0D, 0.9D UNION ALL SELECT null, 0.5D")
    assert [r.n for r in got.select(pop.poisson(F.col("lam"), F.col("u")).alias("n")).collect()][:4] == [0, 2, 3, 8]
    assert [r.n for r in got.where("lam = 0 OR lam IS NULL").select(pop.poisson(F.col("lam"), F.col("u")).alias("n")).collect()] == [0, None]


def test_one_heavy_walker_keeps_its_share(spark):
    p = spark.createDataFrame([(k, 1000.0 if k == 7 else 1.0) for k in range(100)], "walker long, w double")
    for n0 in (1000, 5_000):
        got = {r.walker: r.copies for r in pop.resample_varied(p, n0, 19).collect()}
        lam = n0 * 1000 / 1099
        assert len(got) == 100 and abs(got[7] - lam) < 6 * math.sqrt(lam)
        assert abs(sum(got.values()) - n0) < 6 * math.sqrt(n0)
