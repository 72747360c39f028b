"""Moves of whole populations: proposals, sweeps, resampling. All random numbers are functions of walker and step."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.rng import normal, uniform
from meshwalk.functions.shared import cut
from meshwalk.operators.candidates import in_box
from meshwalk.operators.chain import metropolis_accept

#: Walkers of one block of prefix sums.
BLOCK = 10_000


def propose_continuous(walkers: DataFrame, sizes: list[float], seed: int, step: int, mins: list[float], maxs: list[float], allowed=None) -> DataFrame:
    """Adds new_x (x plus normal steps of the given sizes) and in_range (inside the closed box and allowed)."""
    new = F.array(*[F.col("x")[k] + F.lit(float(s)) * normal(seed, F.col("walker"), step, k) for k, s in enumerate(sizes)])
    w = walkers.withColumn("new_x", new)
    ok = in_box(F.col("new_x"), mins, maxs)
    return w.withColumn("in_range", ok & allowed(F.col("new_x")) if allowed else ok)


def metropolis_sweep(walkers: DataFrame, objective, sizes: list[float], beta: Column, seed: int, steps: range, mins: list[float], maxs: list[float], allowed=None) -> DataFrame:
    """Moves (walker, x, fx) by the given steps; naccepted counts the moves. One projection a step, no shuffle: cut the
    lineage between calls of a few steps each."""
    w = walkers.withColumn("naccepted", F.lit(0).cast("long"))
    for s in steps:
        w = propose_continuous(w, sizes, seed, s, mins, maxs, allowed)
        w = w.withColumn("new_fx", F.when(F.col("in_range"), objective(F.col("new_x"))).otherwise(F.lit(float("inf"))))
        w = metropolis_accept(w, beta, uniform(seed, F.col("walker"), s, "accept"))
        w = w.withColumn("naccepted", F.col("naccepted") + F.col("accepted").cast("long")).drop("new_x", "new_fx", "in_range", "accepted")
    return w


def prefix_sums(population: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Rows with below (sum of w of smaller walkers in their block), and (block, base, mass) over blocks of walkers."""
    p = population.withColumn("block", F.floor(F.col("walker") / block))
    before = Window.partitionBy("block").orderBy("walker").rowsBetween(Window.unboundedPreceding, -1)
    mass = p.groupBy("block").agg(F.sum("w").alias("mass"))
    base = F.coalesce(F.sum("mass").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("below", F.coalesce(F.sum("w").over(before), F.lit(0.0))), mass.withColumn("base", base)


#: Cells that one row is dealt to at a time.
SPAN = 4096


def resample_fixed(population: DataFrame, draws: DataFrame, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(draw, ancestor): each of ``draws`` (draw, u in [0, 1)) picks a walker with probability proportional to w, with
    replacement.

    The axis of cumulated weights is cut into as many cells as there are walkers; a walker stands in all cells that its
    part of the axis touches (twice the walkers at most in all, however the weight is spread), a draw in one. Both meet by
    cell, so that a heavy walker's draws spread over its cells. A walker with more than ``span`` cells is dealt to them in
    two steps, so that no row grows with the population.
    """
    population = cut(population.where("w > 0").select("walker", "w"), "weights")
    p, blocks = prefix_sums(population, block)
    total, n = blocks.agg(F.sum("mass")).first()[0], population.count()
    if not total:
        return draws.select("draw", F.lit(None).cast("long").alias("ancestor")).where(F.lit(False))
    cell = total / n
    w = p.join(blocks.select("block", "base"), "block").select("walker", (F.col("base") + F.col("below")).alias("lo"), "w")
    # a little wider than the weight says: the sums of neighbours are rounded apart
    a, b = F.floor(F.col("lo") / cell * (1 - 1e-9)), F.floor((F.col("lo") + F.col("w")) / cell * (1 + 1e-9))
    w = w.withColumns({"a": a, "b": b})
    wide = F.col("b") - F.col("a") >= span
    far = w.where(wide).withColumn("s", F.explode(F.sequence(F.floor(F.col("a") / span), F.floor(F.col("b") / span)))).repartition("walker", "s")
    far = far.withColumns({"a": F.greatest("a", F.col("s") * span), "b": F.least("b", F.col("s") * span + span - 1)}).drop("s")
    w = w.where(~wide).unionByName(far).select("walker", "lo", F.explode(F.sequence("a", "b")).alias("cell"))
    at = draws.select("draw", (F.col("u") * F.lit(total)).alias("at")).withColumn("cell", F.floor(F.col("at") / cell))
    # the last walker that begins at or before the draw's place
    return at.join(w, "cell").where("lo <= at").groupBy("draw").agg(F.max_by("walker", F.struct("lo", "walker")).alias("ancestor"))


def fixed_population(population: DataFrame, seed: int, step: int, block: int = BLOCK) -> DataFrame:
    """A population (walker, x, fx, lw, ancestor) drawn anew to its own size: walkers keep their numbers and take state and
    ancestor of the walker they draw; weights start again."""
    p = population.withColumn("w", _weights(population))
    d = p.select(F.col("walker").alias("draw"), uniform(seed, F.col("walker"), step, "resample").alias("u"))
    return _take(resample_fixed(p.select("walker", "w"), d, block), p)


def _weights(population: DataFrame) -> Column:
    top = population.agg(F.max("lw")).first()[0]
    return F.exp(F.col("lw") - F.lit(float(top if top is not None else 0.0)))


def _take(chosen: DataFrame, p: DataFrame) -> DataFrame:
    own = p.select(F.col("walker").alias("parent"), "x", "fx", "ancestor")
    j = chosen.select(F.col("draw").alias("walker"), F.col("ancestor").alias("parent")).join(own, "parent")
    return j.select("walker", "x", "fx", F.lit(0.0).alias("lw"), "ancestor", "parent")


def poisson(lam: Column, u: Column, plain: float = 500.0) -> Column:
    """Poisson number (long) of any mean from one uniform number.

    Up to a mean of ``plain`` by inverse distribution function: how many values have a cumulated probability of at most u.
    Above, where exp(-lam) comes near 0, the values are taken in the order mode, mode + 1, mode - 1, mode + 2, ...; both walk
    until nine standard deviations and more are past, where less is left than the 2**-52 that a uniform number resolves.
    """
    reach = F.ceil(9 * F.sqrt(lam)).cast("long") + 40
    s = F.struct(F.exp(-lam).alias("p"), F.exp(-lam).alias("c"), F.lit(0).cast("long").alias("n"))
    step = lambda a, k: F.struct((a["p"] * lam / k).alias("p"), (a["c"] + a["p"] * lam / k).alias("c"), (a["n"] + (a["c"] <= u).cast("long")).alias("n"))
    low = F.aggregate(F.sequence(F.lit(1).cast("long"), F.floor(lam).cast("long") + reach), s, step)["n"]
    m = F.floor(lam).cast("long")
    # probability of the mode, by Stirling's series; the large terms are taken together so that they do not cancel
    p = F.exp(m * F.log1p((lam - m) / m) - (lam - m) - 0.5 * F.log(2 * math.pi * m) - 1 / (12.0 * m) + 1 / (360.0 * m * m * m))
    s = F.struct(p.alias("up"), p.alias("down"), p.alias("c"), F.when(u < p, m).alias("n"))

    def both(a: Column, k: Column) -> Column:
        up, down = a["up"] * lam / (m + k), a["down"] * F.greatest(m - k + 1, F.lit(0)) / lam
        n = F.coalesce(a["n"], F.when(u < a["c"] + up, m + k), F.when(u < a["c"] + up + down, m - k))
        return F.struct(up.alias("up"), down.alias("down"), (a["c"] + up + down).alias("c"), n.alias("n"))

    high = F.coalesce(F.aggregate(F.sequence(F.lit(1).cast("long"), reach), s, both)["n"], m)
    return F.when(lam <= plain, low).otherwise(high)


def resample_varied(population: DataFrame, n0: int, seed: int) -> DataFrame:
    """Adds copies (long) ~ Poisson(n0 * w / sum of w) to each walker, without an upper bound; those with none stay in the
    table with 0. ``n0`` is the size the population keeps about, whatever it has now."""
    total = population.agg(F.sum("w").alias("total"))
    return population.join(F.broadcast(total)).withColumn("copies", poisson(n0 * F.col("w") / F.col("total"), uniform(seed, F.col("walker")))).drop("total")


def varied_population(population: DataFrame, n0: int, seed: int, step: int, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """A population (walker, x, fx, lw, ancestor) in which each walker stands as often as :func:`resample_varied` says, under
    new dense numbers in the order of the old ones; parent is the old number, ancestor is kept, weights start again. A
    walker with very many copies is dealt out in two steps."""
    p = population.withColumn("w", _weights(population))
    total = p.agg(F.sum("w")).first()[0] or 1.0
    c = p.withColumn("copies", poisson(n0 * F.col("w") / F.lit(total), uniform(seed, F.col("walker"), step, "resample"))).where("copies > 0")
    c, blocks = prefix_sums(c.drop("w").withColumn("w", F.col("copies").cast("double")), block)
    c = c.join(blocks.select("block", "base"), "block").withColumn("first", (F.col("base") + F.col("below")).cast("long"))
    c = c.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / span)))).repartition("walker", "s")
    k = F.explode(F.sequence(F.col("s") * span, F.least("copies", (F.col("s") + 1) * span) - 1))
    return c.withColumn("k", k).select((F.col("first") + F.col("k")).alias("new"), "x", "fx", F.lit(0.0).alias("lw"), "ancestor", F.col("walker").alias("parent")).withColumnRenamed("new", "walker")
