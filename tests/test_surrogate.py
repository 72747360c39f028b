"""Surrogate of an objective: against plain formulas, against processes made anew, a search in parts."""

import math

import numpy as np
import pytest

from meshwalk.functions import objectives as obj
from meshwalk.operators import surrogate


def test_surrogate_scores_against_plain_formulas(spark):
    grid = [(k, [-2 + 4 * (k % 21) / 20, -2 + 4 * (k // 21) / 20]) for k in range(441)]
    mesh = spark.createDataFrame(grid, "id long, x array<double>").repartition(3)
    f = lambda x: (x[0] - 0.6) ** 2 + (x[1] + 0.4) ** 2
    seen = spark.createDataFrame([(k, f(x)) for k, x in grid if k % 37 == 0], "id long, fx double")
    x = np.array([g[1] for g in grid])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    at = np.array([k for k, _ in grid if k % 37 == 0])
    y = -np.array([f(v) for v in x[at]])
    gp = surrogate.Surrogate(x[at], y, x.mean(axis=0), x.std(axis=0))
    k = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2) / gp.length**2)
    inv = np.linalg.inv(k(z[at], z[at]) + 1e-6 * np.eye(len(at)))
    mean = y.mean() + y.std() * k(z, z[at]) @ inv @ ((y - y.mean()) / y.std())
    std = y.std() * np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k(z, z[at]), inv, k(z, z[at])), 0))
    for score in ("EI", "PI", "TS"):
        got = {r.id: r for r in surrogate.score_candidates(mesh, seen, score).collect()}
        assert len(got) == 441 - len(at)
        for i, r in got.items():
            assert abs(r["mean"] - mean[i]) < 1e-4 and abs(r["std"] - std[i]) < 1e-3
        best = surrogate.next_probe(surrogate.score_candidates(mesh, seen, score)).first()
        assert best.score == max(r.score for r in got.values()) and np.abs(x[best.id] - [0.6, -0.4]).max() < 0.9


def probes(n, d=2, seed=3):
    r = np.random.default_rng(seed)
    x = r.uniform(-2, 2, (n, d))
    return x, np.sin(1.3 * x[:, 0]) + 0.3 * x[:, -1] ** 2


def test_a_probe_more_is_a_process_made_anew():
    x, y = probes(60)
    mean, std = x.mean(axis=0), x.std(axis=0)
    grown, at = surrogate.Surrogate(x[:40], y[:40], mean, std, 1e-3), probes(30, seed=4)[0]
    for a, b in zip(x[40:], y[40:], strict=True):
        grown.add(a, b)
    assert np.allclose(grown.w, surrogate.inverse_factor(surrogate.kernel(grown.x, grown.x, grown.length), 1e-3), atol=1e-6)
    grown.refit()
    whole = surrogate.Surrogate(x, y, mean, std, 1e-3)
    assert grown.length == whole.length and all(np.allclose(p, q, atol=1e-6) for p, q in zip(grown.predict(at), whole.predict(at), strict=True))


def inducing(x, y, u, like):
    z = (y - y.mean()) / y.std()
    v = surrogate.inverse_factor(surrogate.kernel(u, u, like.length), surrogate.NOISE) @ surrogate.kernel(u, like.scale(x), like.length)
    return surrogate.Inducing(u, like.length, 1e-2, v @ v.T, v @ z, y.mean(), y.std(), like.mean, like.std)


def test_inducing_points_hold_what_all_probes_say():
    x, y = probes(80)
    whole = surrogate.Surrogate(x, y, x.mean(axis=0), x.std(axis=0), 1e-2)
    seen, at = inducing(x, y, whole.scale(x), whole), probes(30, seed=4)[0]
    for p, q in zip(whole.predict(at), seen.predict(at), strict=True):
        assert np.allclose(p, q, atol=1e-3)
    # draws have the mean and the spread that are predicted
    draws = np.array([seen.path(k, 4000)(at) for k in range(200)])
    mean, std = seen.predict(at)
    assert (np.abs(draws.mean(axis=0) - mean) < 5 * std / 200**0.5 + 2e-3).all()
    assert np.abs(np.log(draws.std(axis=0)[std > 1e-3] / std[std > 1e-3])).max() < 0.5
    # probes that come one by one
    u = whole.scale(x[:25])
    grown, k = inducing(x, y, u, whole), 60
    first = inducing(x[:k], y[:k], u, whole)
    first.my, first.sy, first.b = y.mean(), y.std(), first.w @ surrogate.kernel(u, whole.scale(x[:k]), whole.length) @ ((y[:k] - y.mean()) / y.std())
    for a, b in zip(x[k:], y[k:], strict=True):
        first.add(a, b)
    for p, q in zip(grown.predict(at), first.predict(at), strict=True):
        assert np.allclose(p, q, atol=1e-6)


def test_scores_against_the_error_function():
    x, y = probes(15)
    gp = surrogate.Surrogate(x, y, x.mean(axis=0), x.std(axis=0))
    at = np.concatenate([probes(200, seed=5)[0], x[:3]])
    cdf = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    for top in (y.max(), y.max() + 3, y.min() - 1):
        for name in ("PI", "EI"):
            mean, std, got = surrogate.scorer(gp, top, name, 0, 10)(at)
            for m, s, g in zip(mean, std, got, strict=True):
                z = (m - top) / s if s > 0 else math.copysign(math.inf, m - top)
                want = cdf(z) if name == "PI" else (m - top) * cdf(z) + s * math.exp(-z * z / 2) / math.sqrt(2 * math.pi) if s > 0 else max(m - top, 0)
                assert g >= 0 and abs(g - want) < 1e-10 * max(1, abs(want))
    with pytest.raises(ValueError):
        surrogate.scorer(gp, 0.0, "UCB", 0, 10)


def test_many_probes_are_fitted_by_sums(spark):
    x, y = probes(6000, seed=6)
    y = -y + np.random.default_rng(1).normal(0, 0.05, len(y))
    mesh = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(7000, None)], "id long, x array<double>")
    seen = spark.createDataFrame([(k, float(y[k])) for k in range(0, 6000, 2)] + [(1, float("nan")), (3, None), (5, float("inf")), (9999, 1.0)], "id long, fx double")
    got = []
    for parts in (1, 7):
        fitted, top = surrogate.fit_surrogate(mesh.repartition(parts), seen.repartition(parts), 200)
        assert isinstance(fitted, surrogate.Inducing) and len(fitted.x) == 200 and top == -y[::2].min() and 1e-3 < fitted.noise < 1e-2
        got.append(fitted.predict(x))
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(*got, strict=True))
    assert np.abs(got[0][0] + (y - np.random.default_rng(1).normal(0, 0.05, len(y)))).max() < 0.1
    rows = surrogate.score_candidates(mesh, seen, "EI", most=200).collect()
    assert sorted(r.id for r in rows) == [k for k in range(1, 6000, 2) if k not in (1, 3, 5)]


def test_search_on_a_small_mesh(spark, tmp_path):
    points = [(k, [k // 11 - 5.0, k % 11 - 5.0]) for k in range(121)]
    mesh, at = spark.createDataFrame(points, "id long, x array<double>"), {tuple(x): k for k, x in points}
    first = [(3.0, 3.0), (2.0, 1.0), (-5.0, 3.0), (-1.0, 2.0), (-5.0, -4.0)]
    seen = spark.createDataFrame([(at[p], float(obj.rosenbrock_array(np.array([p]))[0])) for p in first], "id long, fx double")
    go = lambda n, folder, f=obj.rosenbrock_array: surrogate.surrogate_search(mesh, seen, f, n, str(tmp_path / folder), "TS", 1, 500, interval=5).orderBy("step").collect()
    whole = go(20, "whole")
    assert len({r.id for r in whole} | {at[p] for p in first}) == 25 and whole[-1].best_fx <= 1.0
    assert all(r.fx == obj.rosenbrock_array(np.array([r.x]))[0] and r.best_fx == min(104.0, *[q.fx for q in whole[: k + 1]]) for k, r in enumerate(whole))
    go(3, "parts")
    assert go(6, "parts") == whole[:6]
    with pytest.raises(ValueError, match="objective"):
        go(6, "parts", obj.himmelblau_array)


def test_search_ends_with_the_candidates(spark, tmp_path):
    mesh = spark.createDataFrame([(k, [float(k)]) for k in range(4)], "id long, x array<double>")
    seen = spark.createDataFrame([(0, 5.0)], "id long, fx double")
    bad = lambda x: np.where(x[:, 0] == 2, np.nan, x[:, 0])
    got = surrogate.surrogate_search(mesh, seen, bad, 9, str(tmp_path / "r"), "EI").orderBy("step").collect()
    assert sorted(r.id for r in got) == [1, 2, 3] and got[-1].best_id == 1 and got[-1].best_fx == 1.0
    with pytest.raises(ValueError):
        surrogate.score_candidates(mesh.limit(0), seen)
    with pytest.raises(ValueError):
        surrogate.score_candidates(mesh, seen.limit(0))
    assert surrogate.score_candidates(mesh, spark.createDataFrame([(k, 1.0) for k in range(4)], "id long, fx double")).count() == 0


def test_repeated_points_are_fitted_once_by_few_tasks(spark, monkeypatch):
    g = np.random.default_rng(5)
    at = g.normal(size=(200, 2))
    rows = [(k, [float(c) for c in at[k % 200]], float(v)) for k, v in enumerate(g.normal(size=3000))]
    p, seen, sums = spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(7), [], surrogate._sums

    def spy(places, *rest):
        seen.append((places.rdd.getNumPartitions(), places.count()))
        return sums(places, *rest)

    monkeypatch.setattr(surrogate, "TASK_PROBES", 10)
    monkeypatch.setattr(surrogate, "FIT_TASKS", 4)
    monkeypatch.setattr(surrogate, "_sums", spy)
    got = surrogate.fit_inducing(p, at.mean(0), at.std(0), 50, 20)
    assert seen == [(4, 200)] * 2
    x, y = got.scale(np.array([r[1] for r in rows])), np.array([r[2] for r in rows])
    v = got.w @ surrogate.kernel(got.x, x, got.length)
    assert np.allclose(got.b, v @ ((y - y.mean()) / y.std()), atol=1e-6)
    assert np.allclose(np.linalg.inv(got.s.T @ got.s), v @ v.T + got.noise * np.eye(50), rtol=1e-4, atol=1e-4)


def test_rows_are_scored_in_slabs(spark):
    p = spark.range(9000).selectExpr("id", "array(double(id)) AS x").coalesce(1)
    most = surrogate.SLAB

    def run(x):
        assert len(x) <= most
        return x[:, 0], x[:, 0], x[:, 0]

    got = surrogate._scored(p, run, surrogate.SCORED, frozenset([7]))
    assert got.count() == 8999 and got.where("score != id").isEmpty()


def test_rows_that_share_places_are_scored_once(spark, monkeypatch):
    rows = [(k, [float(k % 30), float(k % 7)]) for k in range(2100)]
    p, scored, seen = spark.createDataFrame(rows, "id long, x array<double>"), surrogate._scored, []
    o = spark.createDataFrame([(k, float(k % 30)) for k in range(0, 2100, 100)], "id long, fx double")
    monkeypatch.setattr(surrogate, "_scored", lambda left, *rest: (seen.append(left.count()), scored(left, *rest))[1])
    got = {r.id: r for r in surrogate.score_candidates(p, o, "EI").collect()}
    assert seen == [210] and len(got) == 2100 - 21
    monkeypatch.setattr(surrogate, "FEW_PLACES", 0)
    for r in surrogate.score_candidates(p, o, "EI").collect():
        assert abs(r["mean"] - got[r.id]["mean"]) < 1e-9 and abs(r.score - got[r.id].score) < 1e-9
