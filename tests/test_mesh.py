"""Runs on meshes against theory and themselves; manifests of runs."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwalk.functions import objectives as obj
from meshwalk.operators import runs
from meshwalk.operators.mesh import Mesh, anneal_mesh, exchange_mesh


def grid(spark, n=6, hub=False):
    """An n x n grid with its four neighbours; with ``hub`` the first node has all others as neighbours too."""
    e = {(a * n + b, c * n + d) for a in range(n) for b in range(n) for c, d in ((a + 1, b), (a, b + 1)) if c < n and d < n}
    e |= {(0, k) for k in range(1, n * n)} if hub else set()
    e = sorted(e | {(b, a) for a, b in e})
    nodes = spark.createDataFrame([(k, [float(k // n), float(k % n)]) for k in range(n * n)], "id long, x array<double>")
    return nodes, spark.createDataFrame(e + [(3, 3), e[0]], "src long, dst long")


def _value():
    # made here so that it travels to tasks by value
    return lambda x: 0.3 * x[:, 0] + 0.1 * x[:, 1]


value = _value()


def rows(df):
    return sorted(str(r) for r in df.collect())


def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.mark.parametrize("hub", [False, True])
def test_shares_of_nodes_follow_the_weights(spark, hub):
    nodes, edges = grid(spark, 4, hub)
    mesh = Mesh(nodes, edges, value, edges_per_block=20, hub=5, walkers=900)
    w = spark.range(4000).select(F.col("id").alias("walker"), (F.col("id") % 16).alias("x"))
    s = mesh.sweep(mesh.start(w, 1.0, 3).withColumn("beta", F.lit(2.0)), 3, range(1, 26))
    assert s.where("step != 25").count() == 0
    got = np.zeros(16)
    for r in s.groupBy(F.col("x.node").alias("n")).count().collect():
        got[r.n] = r["count"] / 4000
    want = np.exp(-2 * value(np.array([[k // 4, k % 4] for k in range(16)], float)))
    want /= want.sum()
    assert np.abs(got - want).max() < 4.5 * np.sqrt(want.max() / 4000)
    whole = Mesh(nodes, edges, value)  # one block: the same walks
    again = whole.sweep(whole.start(w, 1.0, 3).withColumn("beta", F.lit(2.0)), 3, range(1, 26))
    where = lambda d: rows(d.select("walker", "x.node", "fx", "naccepted", "trial_x.node", "best_fx", "best_x.node"))
    assert where(again) == where(s)


def test_runs_on_meshes_continue_and_find_the_least(spark, tmp_path):
    nodes, edges = grid(spark)
    mesh, w = Mesh(nodes, edges, value, edges_per_block=40), spark.range(36).select(F.col("id").alias("walker"), F.col("id").alias("x"))
    betas, path = [0.0, 2.0, 8.0], folder(tmp_path)
    one = anneal_mesh(w, mesh, betas, [10] * 3, 5, folder(tmp_path))
    anneal_mesh(w, mesh, betas[:2], [10] * 2, 5, path)
    assert rows(anneal_mesh(w, mesh, betas, [10] * 3, 5, path)) == rows(one)
    assert one.agg(F.min_by("best_x", "best_fx")).first()[0].node == 0 and runs.anneal_stats(one).count() == 3
    g = w.withColumnRenamed("walker", "group")
    path = folder(tmp_path)
    one = exchange_mesh(g, mesh, [6.0, 1.0], 3, 5, 5, folder(tmp_path))
    exchange_mesh(g, mesh, [6.0, 1.0], 1, 5, 5, path)
    assert rows(exchange_mesh(g, mesh, [6.0, 1.0], 3, 5, 5, path)) == rows(one)
    assert one.where("step = 15").count() == 72
    with pytest.raises(ValueError, match="another objective"):
        exchange_mesh(g, Mesh(nodes, edges, lambda x: x[:, 0]), [6.0, 1.0], 3, 5, 5, path)
    with pytest.raises(ValueError, match="another mesh"):
        exchange_mesh(g, Mesh(nodes, edges.where("src + dst != 1"), value), [6.0, 1.0], 3, 5, 5, path)


def test_a_run_goes_on_only_as_it_began(spark, tmp_path):
    p = spark.range(30).select(F.col("id").alias("walker"), F.array(F.sin("id"), F.cos("id")).alias("x"))
    path = folder(tmp_path)

    def go(points=p, f=obj.quadratics_array, betas=(0.0, 1.0, 2.0), sizes=(0.3, 0.3), top=2.0, seed=3, allowed=None):
        return runs.anneal(points, f, list(betas), [5] * len(betas), list(sizes), [-2.0, -2.0], [top, top], seed, path, allowed=allowed)

    want = rows(go())
    shift = 1.0
    for name, other in {"box": {"top": 100.0}, "step sizes": {"sizes": (0.3, 0.4)}, "objective": {"f": lambda x: (x * x).sum(axis=1) + shift}, "constraint": {"allowed": lambda x: x[:, 0] > -9}, "seed": {"seed": 4}, "starting points": {"points": p.where("walker < 29")}, "plan": {"betas": (0.0, 1.5)}}.items():
        with pytest.raises(ValueError, match=f"another {name}"):
            go(**other)
    with pytest.raises(ValueError, match="another"):
        runs.replica_exchange(p.withColumnRenamed("walker", "group"), obj.quadratics_array, [1.0], 2, 5, [0.3, 0.3], [-2.0] * 2, [2.0] * 2, 3, path)
    # a table that was changed is made again
    spark.read.parquet(f"{path}/state/k=1").limit(7).write.parquet(f"{path}/other")
    spark.read.parquet(f"{path}/other").write.mode("overwrite").parquet(f"{path}/state/k=1")
    assert rows(go()) == want


def test_starting_points_are_in_the_box_and_allowed(spark):
    p = spark.createDataFrame([(k, [500.0 if k % 2 else 0.5, -1.0]) for k in range(40)], "walker long, x array<double>")
    r = runs.start_walkers(p, obj.quadratics_array, 1.0, mins=[-2.0, -2.0], maxs=[2.0, 2.0], allowed=lambda x: x[:, 0] > 0, seed=1).collect()
    assert all(0 < w.x[0] <= 2 and -2 <= w.x[1] <= 2 for w in r) and all(w.x == [0.5, -1.0] for w in r if w.walker % 2 == 0)
    with pytest.raises(Exception, match="not allowed"):
        runs.start_walkers(p, obj.quadratics_array, 1.0, mins=[-2.0, -2.0], maxs=[2.0, 2.0], allowed=lambda x: x[:, 0] > 9).collect()
