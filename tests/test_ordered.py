"""Scans along an order: hot keys, long steps, many ranges."""

import pytest
from pyspark.sql import functions as F

from meshwalk.operators import chain as ch
from meshwalk.operators.ordered import Ordered


def plain(rows):
    """(key, step, sub) -> (previous value, running sum, running minimum) by one pass in order."""
    out, last = {}, {}
    for k, s, u, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        p, t, m = last.get(k, (None, 0, x))
        out[(k, s, u)] = (p, t + x, min(m, x))
        last[k] = (x, t + x, min(m, x))
    return out


@pytest.mark.parametrize("rows", [10_000, 50])
def test_scans_equal_one_pass_with_a_hot_key_and_a_long_step(spark, rows):
    data = [(0 if k % 10 else k % 7 or None, k % 3 if k < 2500 else 9, k, (k * 7919) % 1009) for k in range(3200)]
    d = spark.createDataFrame(data, "key int, step long, sub long, x long").repartition(5)
    o = Ordered(d, ["key"], ["step", "sub"], rows).previous("x", "old").running_sum(F.col("x"), "total").running_min("x", "low")
    got = {(r.key, r.step, r["sub"]): (r.old, r.total, r.low) for r in o.df.collect()}
    assert got == plain(data)
    assert o.df.columns == ["key", "step", "sub", "x", "old", "total", "total_all", "low"]


def test_tasks_grow_with_rows_at_few_steps(spark):
    d = spark.range(1_000_000).select(F.lit(0).alias("t_index"), F.lit(7).cast("long").alias("step"), F.col("id").alias("walker"), F.array((F.floor(F.col("id") / 4) % 2).cast("double")).alias("x"))
    o = Ordered(d, ["t_index"], ["step", "walker"], 16_000)
    n = [r["count"] for r in o._df.groupBy("__range").count().collect()]
    assert len(n) > 55 and max(n) < 40_000
    assert abs(ch.move_ratio(d, ["step", "walker"], rows=16_000).first().acceptance - 249_999 / 1_000_000) < 1e-12


def test_last_rows_of_a_hot_group(spark):
    d = spark.range(5000).select(F.lit(1).alias("rank"), (F.col("id") % 2 * 0).alias("t_index"), F.col("id").alias("step"))
    for n in (50, 1500):
        assert sorted(r.step for r in ch.last_snapshot(d, n, ["step"], rows=300).collect()) == list(range(5000 - n, 5000))


def test_ranks_get_dense_ids(spark):
    t = [spark.range(n).select(F.lit(k).alias("rank"), F.col("id").alias("step")) for k, n in enumerate((300, 0, 7, 800))]
    got = sorted((r.id, r["rank"], r.step) for r in ch.union_ranks(t, ["step"], rows=64).collect())
    assert [g[0] for g in got] == list(range(1107)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
