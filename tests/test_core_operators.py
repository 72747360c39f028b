import pytest
from pyspark.sql import functions as F

from meshwalk.operators import candidates as cand
from meshwalk.operators import chain as ch
from meshwalk.operators import graph as gr


def test_grid_order(spark):
    two = [tuple(r.x) for r in cand.grid_points(spark, [-5, -5], [5, 5], [11, 11]).orderBy("id").collect()]
    assert len(two) == 121 and two[:2] == [(-5.0, -5.0), (-4.0, -5.0)]
    np = pytest.importorskip("numpy")
    axes = [np.linspace(0, 1, 2), np.linspace(0, 2, 3), np.linspace(0, 3, 4)]
    want = np.array(np.meshgrid(*axes, indexing="xy")).reshape(3, -1).T
    got = [r.x for r in cand.grid_points(spark, [0, 0, 0], [1, 2, 3], [2, 3, 4]).orderBy("id").collect()]
    assert np.allclose(got, want)


def test_walkers_are_allowed_and_repeatable(spark):
    ok = lambda x: cand.satisfies(x, [[1, -1]], [0])
    a = cand.init_walkers(spark, [-1, -1], [1, 1], 50, ok, seed=4)
    assert a.count() == 50 and a.where(~ok(F.col("x"))).isEmpty()
    b = cand.init_walkers(spark, [-1, -1], [1, 1], 50, ok, seed=4)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(RuntimeError):
        cand.init_walkers(spark, [0], [1], 3, lambda x: F.lit(False), max_tries=2)


def test_annealing_plan():
    assert cand.annealing_plan(numsteps=10, n_t=4) == [3, 3, 2, 2]
    with pytest.raises(ValueError):
        cand.annealing_plan(numsteps=10)


def test_schedule_errors(spark):
    for bad in ({}, {"tmin": 1, "tmax": 2, "bmin": 1, "bmax": 2}, {"tmin": 3, "tmax": 2}, {"bmin": 0, "bmax": 1}):
        with pytest.raises(ValueError):
            cand.temperature_schedule(spark, 3, **bad)


def test_neighbours_and_components(spark):
    p = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "id long, x array<double>")
    e = gr.radius_neighbors(p, 1.5, 2)
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert gr.missing_reverse(e).isEmpty()
    assert {r.id: r.component for r in gr.connected_components(p, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    line = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r.component for r in gr.connected_components(spark.range(201), line).collect()} == {0}


def test_chunks_do_not_change_moves_or_bests(spark):
    c = spark.range(300).select((F.col("id") % 3).alias("t_index"), F.col("id").alias("step"), F.array((F.col("id") / 7).cast("int").cast("double")).alias("x"))
    a, b = (sorted(map(str, ch.move_ratio(c, ["step"], 30, chunk).collect())) for chunk in (10, 10_000))
    assert a == b
    h = spark.range(200).select(F.lit("r").alias("run"), F.col("id").alias("step"), F.col("id"), F.when(F.col("id") % 9 == 0, F.lit(float("nan"))).otherwise(F.cos(F.col("id"))).alias("fx"))
    a, b = (sorted(map(str, ch.running_best(h, chunk).collect())) for chunk in (7, 10_000))
    assert a == b


def test_radius_join_of_units_loops_and_dense_cells(spark):
    p = spark.createDataFrame([(k, [0.01 * (k % 7), 0.02 * (k % 5), 0.03 * (k % 3), float(k % 2)]) for k in range(120)], "id long, x array<double>")
    x = {r.id: r.x for r in p.collect()}
    for unit, loop in (None, False), ([1.0, 2.0, 1.0, 3.0], True):
        u = unit or [1.0] * 4
        d = lambda a, b, u=u: sum(((s - t) / w) ** 2 for s, t, w in zip(a, b, u, strict=True)) ** 0.5
        want = {(a, b) for a in x for b in x if (loop or a != b) and d(x[a], x[b]) <= 0.35}
        for points in (10_000, 7):
            got = [tuple(r) for r in gr.radius_neighbors(p, 0.35, 4, unit, loop, points).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_meshes_are_checked(spark):
    n = spark.range(4)
    good = spark.createDataFrame([(a, b) for k in range(3) for a, b in ((k, k + 1), (k + 1, k))], "src long, dst long")
    gr.require_mesh_graph(n, good)
    with pytest.raises(ValueError, match="parts"):
        gr.require_mesh_graph(spark.range(5), good)
    with pytest.raises(ValueError, match="reverse"):
        gr.require_mesh_graph(n, good.where("src != 3"))


def test_one_row_zero_and_nan(spark):
    c = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, float("nan")), (2, float("inf")), (3, 1.0), (3, 3.0)], "t_index long, fx double")
    assert {r.t_index: (r.n, r.mean, r.stderr) for r in ch.fx_moments(c).collect()} == {0: (1, 1.0, None), 1: (1, 2.0, None), 3: (2, 2.0, 1.0)}
    p = spark.createDataFrame([(0, 5.0, 0.0), (1, 1.0, 0.0), (1, 2.0, -1e6)], "t_index long, fx double, lw double")
    assert {r.t_index: (r.mean, r.err) for r in ch.weighted_jackknife(p).collect()} == {0: (5.0, None), 1: (1.0, None)}
    a = spark.createDataFrame([(0, 0, 0), (1, 1, 2)], "t_index long, accepted long, tried long")
    assert {r.t_index: r.acceptance for r in ch.acceptance_counts(a).collect()} == {0: None, 1: 0.5}
    e = spark.createDataFrame([(0.0, 7.0), (1.0, float("nan")), (2.0, float("inf"))], "beta double, evidence double")
    assert ch.optimal_noise(e).first().sigma == float("inf")
    h = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 2.0)], "t_index long, v double, w double")
    assert {r.t_index: r.w for r in ch.hist1d(h, ["v"], 4, None, weight="w").collect()} == {0: None, 1: 1.0}


def test_large_log_weights(spark):
    import numpy as np

    v = np.array([-3000.0, -2999.5, 700.0, 699.0, -float("inf")])
    d = spark.createDataFrame([(0, float(x)) for x in v], "k long, v double")
    assert abs(ch._log_mean_exp(d, "k", "v", "m").first().m - (700 + np.log(np.exp(v - 700).sum() / 5))) < 1e-12


def test_chunks_do_not_change_runs_paths_and_calls(spark):
    c = spark.range(500).select((F.col("id") % 7 % 2).alias("rank"), F.col("id").alias("step"), F.floor(F.col("id") / 9 % 3).cast("double").alias("temp"))
    last, want = {}, {}
    for r in c.orderBy("step").collect():
        n, t = last.get(r.rank, (0, r.temp))
        last[r.rank] = (n + (t != r.temp), r.temp)
        want[(r.rank, r.step)] = last[r.rank][0]
    for chunk in (10, 100_000):
        assert {(r.rank, r.step): r.run_index for r in ch.temperature_runs(c, ["step"], chunk).collect()} == want
    h = c.withColumn("run", F.col("rank"))
    one, many = ({r.step for r in ch.trim_path(h, 5, ["step"], k).collect()} for k in (100_000, 3))
    ends = [sorted(s for q, s in want if q == k) for k in (0, 1)]
    assert one == many == {s for e in ends for s in e[5:-1]}
    k = spark.range(300).select((F.col("id") % 2).alias("rank"), F.col("id").alias("call"), F.floor(F.col("id") / 3).cast("double").alias("t"))
    a, b = (sorted(map(tuple, ch.call_profile(k, n).collect())) for n in (2, 100_000))
    assert a == b and a[0] == (0, 0, 1, 0.0, 0.0)


def test_distinct_temperatures_by_ranges(spark):
    t = [1.0 + 1e-7 * (k % 40) + (k // 40) for k in range(400)] + [2.0] * 500
    d = spark.createDataFrame([(x,) for x in t], "temp double")
    for parts in (1, 50):
        assert sorted((round(r.value, 6), r.n) for r in ch.distinct_temperatures(d, parts).collect()) == [(1.0 + k, 540 if k == 1 else 40) for k in range(10)]
