"""Cells around pivots against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwalk.operators import graph as gr
from meshwalk.operators.metric import Cells, choose_pivots


def frame(spark, x, parts=5):
    return spark.createDataFrame([(k, [float(c) for c in row]) for k, row in enumerate(x)], "id long, x array<double>").repartition(parts)


def all_pairs(x, radius):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    a, b = np.nonzero(np.triu(d <= radius, 1))
    return set(zip(a.tolist(), b.tolist(), strict=True))


def clusters(n, dim, seed=0, centres=40, spread=0.05):
    g = np.random.default_rng(seed)
    c = g.normal(size=(centres, dim))
    return c[g.integers(0, centres, n)] + spread * g.normal(size=(n, dim))


@pytest.mark.parametrize("dim,radius,cell", [(5, 0.15, 60), (20, 0.3, 100), (64, 0.5, 250)])
def test_clusters_are_split_and_no_pair_is_lost(spark, dim, radius, cell):
    x = clusters(1200, dim, dim)
    c = Cells(frame(spark, x), radius, cell)
    got = [tuple(sorted(r)) for r in c.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, radius)
    assert c.candidates().agg(F.sum("pairs")).first()[0] < 0.15 * 1200 * 1199 / 2
    assert c.sizes.agg(F.sum("own")).first()[0] == 1200


def test_a_dense_group_beside_a_sparse_one(spark):
    g = np.random.default_rng(3)
    x = np.concatenate([0.001 * g.normal(size=(300, 6)), 5 * g.normal(size=(500, 6)), np.zeros((40, 6))])
    got = [tuple(sorted(r)) for r in Cells(frame(spark, x), 0.9, 50).pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, 0.9)


def test_points_that_pivots_cannot_part_meet_in_blocks(spark):
    x = np.random.default_rng(1).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = Cells(frame(spark, x), 1.2, 60)
    assert c.sizes.count() == 1 and len(choose_pivots(x, 1.2)) == 1
    got = [tuple(sorted(r)) for r in c.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, 1.2)


def test_odd_rows(spark):
    odd = spark.createDataFrame([(0, [0.0] * 4), (1, [0.0] * 4), (2, None), (3, [0.0, None, 0.0, 0.0]), (4, [float("nan"), 0.0, 0.0, 0.0]), (None, [0.0] * 4), (5, [1.0, 0.0, 0.0, 0.0])], "id long, x array<double>")
    assert sorted(map(tuple, gr.radius_neighbors(odd, 1.0, 4).collect())) == [(0, 1), (0, 5), (1, 0), (1, 5), (5, 0), (5, 1)]
    assert gr.radius_neighbors(odd.limit(0), 1.0, 4).isEmpty()


def test_a_large_cell_is_dealt_to_few_parts(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    c = Cells(frame(spark, x), 1.2, 20)
    assert [(r.pa, r.pb) for r in c.parts().collect()] == [(8, 8)]
    got = [tuple(sorted(r)) for r in c.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, 1.2)
    monkeypatch.setattr("meshwalk.operators.metric.SIDE_BYTES", 64 * 8 * 25)
    assert [(r.pa, r.pb) for r in c.parts().collect()] == [(16, 16)]
