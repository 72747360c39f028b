"""Whole runs and searches: against theory, against themselves in parts, against plain versions."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwalk.functions import objectives as obj
from meshwalk.operators import chain as ch
from meshwalk.operators import population as pop
from meshwalk.operators import runs, searches


def starts(spark, n, dim=1, name="walker", parts=3):
    x = F.array(*[F.sin(F.col("id") * 1.7 + k) * 8 for k in range(dim)])
    return spark.range(n).repartition(parts).select(F.col("id").alias(name), x.alias("x"))


def rows(df):
    return sorted(str(r) for r in df.collect())


def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


BETAS = [0.5 * k for k in range(6)]


def anneal(spark, path, upto=6, fixed=True, parts=3, n=400):
    return runs.anneal(starts(spark, n, parts=parts), obj.quadratics_array, BETAS[:upto], [30] * upto, [0.8], [-10.0], [10.0], 3, path, interval=2, fixed=fixed)


@pytest.mark.parametrize("fixed", [True, False])
def test_annealing_finds_the_mean_and_continues(spark, tmp_path, fixed):
    one = anneal(spark, folder(tmp_path), fixed=fixed)
    s = {r.t_index: r for r in runs.anneal_stats(one, 2).collect()}
    for k, b in enumerate(BETAS):
        if b:
            assert abs(s[k]["mean"] - 1 / (2 * b)) < 0.25 / b and s[k]["beta"] == b
    # log of the partition function: sqrt(pi / beta) over the box's 20
    assert abs(s[5]["logz"] - math.log(math.sqrt(math.pi / 2.5) / 20)) < 0.5
    assert 250 < s[5]["n"] < 600 and (not fixed or s[5]["n"] == 400) and one.agg(F.min("best_fx")).first()[0] < 1e-4
    path = folder(tmp_path)
    anneal(spark, path, 3, fixed)
    assert rows(anneal(spark, path, 6, fixed, parts=1)) == rows(one)
    with pytest.raises(ValueError):
        runs.anneal(starts(spark, 9), obj.quadratics_array, [7.0], [30], [0.8], [-10.0], [10.0], 3, path)


def test_an_unfinished_temperature_is_made_again(spark, tmp_path):
    import shutil

    path = folder(tmp_path)
    want = rows(anneal(spark, path, n=50))
    shutil.rmtree(f"{path}/state/k=4")
    (tmp_path / path / "state/k=5/_SUCCESS").unlink()
    assert rows(anneal(spark, path, n=50)) == want


def test_exchange_in_parts(spark, tmp_path):
    def go(path, rounds, parts=3):
        return runs.replica_exchange(starts(spark, 40, 2, "group", parts), obj.himmelblau_array, [2.0, 1.0, 0.1], rounds, 10, [0.5, 0.5], [-6.0, -6.0], [6.0, 6.0], 5, path, allowed=lambda x: x[:, 0] > x[:, 1])

    path = folder(tmp_path)
    one = go(folder(tmp_path), 6)
    go(path, 2)
    assert rows(go(path, 6, 1)) == rows(one)
    last = one.where("step = 60")
    assert last.count() == 120 and {r.t_index: r["count"] for r in last.groupBy("t_index").count().collect()} == {0: 40, 1: 40, 2: 40}
    assert last.where("walker % 3 != t_index").count() > 0 and one.where("x[0] <= x[1] and best_fx < fx").count() == 0
    assert one.agg(F.min("best_fx")).first()[0] < 0.5
    hot = {r.t_index: r["mean"] for r in ch.fx_moments(one.where("step > 20")).collect()}
    assert hot[0] < hot[1] < hot[2]


def test_sweeps_do_not_depend_on_partitions_and_errors_become_nan(spark):
    def bad(x):
        if (x > 3).any():
            raise ValueError("solver")
        return (x * x).sum(axis=1)

    log = []
    for parts in (1, 4):
        w = runs.start_walkers(starts(spark, 60, 2, parts=parts), bad, 1.0, ignore_error=True)
        log.append(rows(runs.sweep(w, bad, [1.0, 1.0], 7, range(1, 6), [-9.0, -9.0], [9.0, 9.0], every=True, ignore_error=True)))
    assert log[0] == log[1] and len(log[0]) == 300 and any("trial_fx=nan" in r for r in log[0])
    with pytest.raises(Exception, match="solver"):
        runs.start_walkers(starts(spark, 60, 2), bad, 1.0).collect()


def test_resampling_shares(spark):
    w = [50.0, 0.0, 1.0, 3.0, 0.0, 46.0]
    p = spark.createDataFrame([(k, x) for k, x in enumerate(w)], "walker long, w double")
    u = (np.arange(5000) + 0.5) / 5000
    d = spark.createDataFrame([(int(k), float(x)) for k, x in enumerate(u)], "draw long, u double")
    want = np.searchsorted(np.cumsum(w) / 100, u, side="right")
    for block, span in ((1, 2), (10_000, 4096)):
        assert [r.ancestor for r in pop.resample_fixed(p, d, block, span).orderBy("draw").collect()] == want.tolist()
    q = spark.createDataFrame([(k, [float(k)], 1.0, math.log(x) if x else -float("inf"), k) for k, x in enumerate(w)], "walker long, x array<double>, fx double, lw double, ancestor long")
    for span in (3, 4096):
        r = pop.varied_population(q, 3000, 5, 1, block=2, span=span).collect()
        assert sorted(x.walker for x in r) == list(range(len(r))) and abs(len(r) - 3000) < 6 * 3000**0.5
        n = np.bincount([x.parent for x in r], minlength=6)
        assert all(abs(a - 30 * b) <= 6 * (30 * b) ** 0.5 for a, b in zip(n, w, strict=True)) and all(x.x == [float(x.parent)] and x.ancestor == x.parent for x in r)


def test_simplex_reaches_the_minimum_from_everywhere(spark):
    s = searches.multistart_simplex(starts(spark, 40, 2, "id").withColumn("x", F.transform("x", lambda v: v / 2)), obj.rosenbrock_array, [0.25, 0.25], [-5.0, -5.0], [5.0, 5.0])
    got = s.collect()
    assert len(got) == 40 and all(r.converged and abs(r.x[0] - 1) < 1e-3 and abs(r.x[1] - 1) < 2e-3 for r in got)
    assert searches.best_start(s).first().fx == min(r.fx for r in got)
    cut = searches.multistart_simplex(starts(spark, 5, 2, "id"), obj.rosenbrock_array, [0.25, 0.25], [-9.0, -9.0], [9.0, 9.0], maxiter=3)
    assert all(r.iterations == 3 and not r.converged for r in cut.collect())


def test_simplex_searches_in_parts_and_their_histories(spark):
    box, few = ([-1.5, -1.5], [5.0, 5.0]), starts(spark, 30, 2, "id").withColumn("x", F.transform("x", lambda v: v / 6))
    allowed = lambda x: x[:, 0] + x[:, 1] < 4
    whole = {r.id: r for r in searches.multistart_simplex(few, obj.rosenbrock_array, [0.25, 0.25], *box, allowed=allowed).collect()}
    part = searches.multistart_simplex(few, obj.rosenbrock_array, [0.25, 0.25], *box, allowed=allowed, maxiter=7)
    for n in (7, 20, 10_000):
        part = searches.continue_simplex(part, obj.rosenbrock_array, *box, allowed=allowed, maxiter=n)
    assert {r.id: r for r in part.collect()} == whole
    log = searches.simplex_log(few, obj.rosenbrock_array, [0.25, 0.25], *box, allowed=allowed).collect()
    for i, r in whole.items():
        best = sorted((q.step, q.x, q.fx) for q in log if q.id == i and q.kind == "iteration")
        calls = sorted((q.step, q.x, q.fx) for q in log if q.id == i and q.kind == "evaluation")
        assert [q[0] for q in best] == list(range(r.iterations + 1)) and best[-1][1:] == (r.x, r.fx)
        assert all(a[2] >= b[2] for a, b in zip(best[1:], best[2:], strict=False))
        assert [q[0] for q in calls] == list(range(1, len(calls) + 1)) and len(calls) <= r.evaluations and min(q[2] for q in calls) == r.fx
        assert all(-1.5 < v < 5 for q in calls for v in q[1]) and all(sum(q[1]) < 4 for q in calls)
        # a plain search, point by point
        assert plain_simplex(best[0][1], lambda x: obj.rosenbrock_array(np.array([x]))[0] if all(-1.5 < v < 5 for v in x) and sum(x) < 4 else math.inf) == [(q[1], q[2]) for q in best]


def plain_simplex(x, f):
    """Best point after each iteration of one search."""
    s = [(list(x), f(x))] + [((p := [v + 0.25 * (k == j) for j, v in enumerate(x)]), f(p)) for k in range(len(x))]
    out = [s[0]]
    while True:
        s.sort(key=lambda p: p[1])
        if out[-1] is None:
            out[-1] = s[0]
        if max(abs(a - b) for p, _ in s[1:] for a, b in zip(p, s[0][0], strict=True)) <= 1e-4 and max(abs(q - s[0][1]) for _, q in s[1:]) <= 1e-4:
            return out
        out.append(None)
        mid, (worst, high) = np.mean([p for p, _ in s[:-1]], axis=0), s[-1]
        go = lambda c: (lambda p: (list(p), f(list(p))))(mid + c * (mid - np.array(worst)))
        r = go(1.0)
        if r[1] < s[0][1]:
            e = go(2.0)
            s[-1] = e if e[1] < r[1] else r
        elif r[1] < s[-2][1]:
            s[-1] = r
        else:
            c = go(0.5) if r[1] < high else go(-0.5)
            if (c[1] <= r[1]) if r[1] < high else (c[1] < high):
                s[-1] = c
            else:
                s[1:] = [((p := list(np.array(s[0][0]) + 0.5 * (np.array(q) - np.array(s[0][0])))), f(p)) for q, _ in s[1:]]


def test_growing_logs_are_read_once(spark, tmp_path):
    from meshwalk.streaming.chain_stats import stream_fx_moments

    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    schema = "t_index long, fx double"
    spark.createDataFrame([(0, 1.0), (0, 3.0), (1, float("nan")), (2, 5.0)], schema).write.mode("append").parquet(log)
    go = lambda: {r.t_index: (r.n, r["mean"], r.stderr, r.best) for r in stream_fx_moments(spark, spark.readStream.schema(schema).parquet(log), folder=state).collect()}
    assert go() == {0: (2, 2.0, 1.0, 1.0), 2: (1, 5.0, None, 5.0)}
    spark.createDataFrame([(0, 5.0), (1, 2.0)], schema).write.mode("append").parquet(log)
    got = go()
    assert got[1] == (1, 2.0, None, 2.0) and got[0][:2] == (3, 3.0)
    offsets = sorted(p.name for p in (tmp_path / "state/state/offsets").iterdir() if p.name.isdigit())
    assert offsets == ["0", "1"]
    again = go()
    assert again == got


def test_a_log_in_parts_has_the_statistics_of_the_whole(spark, tmp_path):
    from meshwalk.streaming.chain_stats import stream_chain_stats

    schema, r = "t_index long, step long, walker long, fx double, x array<double>", np.random.default_rng(2)
    rows = [(int(t), s, w, float(r.normal()), [float(r.integers(3))]) for s in range(60) for w in range(2) for t in [r.integers(3)]]
    rows[5] = (*rows[5][:3], float("nan"), rows[5][4])
    rows[6] = (*rows[6][:3], None, None)
    rows += [(9, 41, 0, -7.0, [1.0])]
    log, order = str(tmp_path / "log"), ["step", "walker"]
    put = lambda part: spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(log)
    go = lambda folder, n=None: {q.t_index: q for q in stream_chain_stats(spark, spark.readStream.schema(schema).option("maxFilesPerTrigger", 99).parquet(log), order, 10, str(tmp_path / folder), n).collect()}
    for lo, hi in ((0, 20), (20, 40), (40, 60)):
        put([q for q in rows if lo <= q[1] < hi])
        got = go("parts", 7)
    whole, chain = go("whole"), spark.createDataFrame(rows, schema)
    want = {q.t_index: q.acceptance for q in ch.move_ratio(chain, order, 10).collect()}
    assert set(got) == set(whole) == {0, 1, 2, 9}
    for t, q in got.items():
        f = np.array([p[3] for p in rows if p[0] == t and p[1] >= 10 and p[3] is not None and math.isfinite(p[3])])
        assert q.n == len(f) and abs(q["mean"] - f.mean()) < 1e-12 and (q.stderr is None if len(f) == 1 else abs(q.stderr - f.std(ddof=0) / (len(f) - 1) ** 0.5) < 1e-12)
        assert q.best == min((p[3], p[1], p[2], p[4]) for p in rows if p[0] == t and p[3] is not None and not math.isnan(p[3]))
        assert abs(q.acceptance - want[t]) < 1e-12 and whole[t].best == q.best and abs(whole[t].acceptance - q.acceptance) < 1e-12
    assert len(list((tmp_path / "parts/result").iterdir())) == 2 and go("parts") == got
    put([(0, 3, 0, 1.0, [1.0])])
    with pytest.raises(Exception, match="come before"):
        go("parts")
