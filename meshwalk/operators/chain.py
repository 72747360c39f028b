"""Sampling-log analysis on chain tables (rank, step, walker, t_index, beta, fx, x, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut
from meshwalk.operators.ordered import Ordered, few

def finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != float("inf"))


def thin(chain: DataFrame, every: int) -> DataFrame:
    return chain.where(F.col("step") % every == 0)


def burn_in(chain: DataFrame, ratio: float, numsteps: int) -> DataFrame:
    return chain.where(F.col("step") >= numsteps * ratio)


def global_walker(chain: DataFrame, n_per_rank: int) -> DataFrame:
    return chain.withColumn("gwalker", F.col("walker") + F.col("rank") * n_per_rank)


def fx_moments(chain: DataFrame, by: str = "t_index") -> DataFrame:
    """n, mean and standard error of finite fx in each group; one row has a null error."""
    c = chain.where(finite(F.col("fx")))
    return c.groupBy(by).agg(F.count("fx").alias("n"), F.avg("fx").alias("mean"), F.sqrt(F.try_divide(F.var_pop("fx"), F.count("fx") - 1)).alias("stderr"))


def _close(x: Column, old: Column) -> Column:
    return F.forall(F.zip_with(x, old, lambda a, b: F.abs(a - b) <= 1e-8 + 1e-5 * F.abs(b)), lambda v: v)


def move_ratio(chain: DataFrame, order: list[str], from_step: float = 0, rows: int | None = None) -> DataFrame:
    """Share of rows from ``from_step`` on that differ from the row before at their temperature; a row with none before is
    not a move. ``rows``: what one task takes at a time (:class:`Ordered`)."""
    c = chain.select(*dict.fromkeys(["t_index", "step", "x", *order]))
    c = Ordered(c, ["t_index"], order, rows).previous("x", "old").df.where(F.col("step") >= from_step)
    moved = F.when(F.col("old").isNull(), False).otherwise(~_close(F.col("x"), F.col("old")))
    return c.groupBy("t_index").agg(F.avg(moved.cast("double")).alias("acceptance"))


def log_z_steps(chain: DataFrame, schedule: DataFrame) -> DataFrame:
    """log mean exp(-(beta of the next colder temperature - beta) f) of each temperature, shifted by its maximum."""
    nxt = schedule.select("t_index", "beta", (F.lead("beta").over(Window.orderBy("beta")) - F.col("beta")).alias("db"))
    v = chain.select("t_index", "fx").join(few(nxt), "t_index").where("db is not null").withColumn("v", -F.col("db") * F.col("fx"))
    return _log_mean_exp(v, "t_index", "v", "dlogz")


def log_z(chain: DataFrame, schedule: DataFrame) -> DataFrame:
    """Running sum of the steps from the hottest temperature (0) to the coldest; tables of one row a temperature."""
    s = schedule.select("t_index", "beta").join(log_z_steps(chain, schedule), "t_index", "left")
    w = Window.orderBy("beta").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("t_index", "beta", F.coalesce(F.sum("dlogz").over(w), F.lit(0.0)).alias("logz"))


def exchange_stats(chain: DataFrame, schedule: DataFrame, from_step: float, order: list[str]) -> DataFrame:
    """beta, mean, stderr, n, logz, acceptance of each temperature after burn-in: one pass for the sums over fx, one for the
    moves."""
    late = chain.where(F.col("step") >= from_step)
    return fx_moments(late).join(log_z(late, schedule), "t_index").join(move_ratio(chain.select("t_index", "x", *order), order, from_step), "t_index").select("t_index", "beta", "mean", "stderr", "n", "logz", "acceptance")


def best_row(df: DataFrame, ties: list[str], columns: list[str]) -> DataFrame:
    """The row of the smallest fx, NaN left out; ties go by ``ties``."""
    return df.where(~F.isnan("fx")).agg(F.min_by(F.struct(*columns), F.struct("fx", *ties)).alias("b")).select("b.*")


def top_k(df: DataFrame, k: int, ties: list[str]) -> DataFrame:
    return df.orderBy("fx", *ties).limit(k)


def separate_by_temperature(chain: DataFrame, schedule: DataFrame, n_per_rank: int) -> DataFrame:
    """Exact temperature to index, one numbering of walkers, ready to be written by temperature."""
    s = schedule.select("temp", F.col("t_index").alias("k"))
    return global_walker(chain.join(few(s), "temp"), n_per_rank).select(F.col("k").alias("t_index"), "step", "gwalker", "fx", "x")


def temperature_runs(chain: DataFrame, order: list[str], rows: int | None = None) -> DataFrame:
    """A number that grows whenever the temperature changes along each rank's log."""
    c = Ordered(chain, ["rank"], order, rows).previous("temp", "old")
    return c.running_sum(F.coalesce((F.col("temp") != F.col("old")).cast("long"), F.lit(0).cast("long")), "run_index").df.drop("old", "run_index_all")


def running_best(history: DataFrame, rows: int | None = None) -> DataFrame:
    """Best fx so far, with its step and id, at every step of each run."""
    h = history.select("run", "step", "id", "fx").withColumn("me", F.when(~F.isnan("fx"), F.struct("fx", "step", "id")))
    best = Ordered(h, ["run"], ["step", "id"], rows).running_min("me", "best").df
    return best.select("run", "step", "id", "fx", F.col("best.fx").alias("best_fx"), F.col("best.step").alias("best_step"), F.col("best.id").alias("best_id"))


def call_profile(calls: DataFrame, rows: int | None = None) -> DataFrame:
    """Number, seconds since the last call and since the first one, of each rank's calls (t in seconds)."""
    c = Ordered(calls.select("rank", "call", "t"), ["rank"], ["t", "call"], rows).previous("t", "old").running_sum(F.lit(1).cast("long"), "num_calls").df
    first = few(calls.groupBy("rank").agg(F.min("t").alias("first")))
    return c.join(first, "rank").select("rank", "call", F.col("num_calls").cast("int").alias("num_calls"), F.coalesce(F.col("t") - F.col("old"), F.lit(0.0)).alias("elapsed_last"), (F.col("t") - F.col("first")).alias("elapsed_start"))


#: Last rows of a group up to which every task keeps its own candidates, before they meet.
KEPT = 1000


def last_snapshot(chain: DataFrame, n: int | None = None, order: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rows of the last step of every (rank, temperature), or its last n rows along ``order``.

    Up to ``KEPT`` rows, every task keeps the last n of each group that it has (Spark's limit below the window), and only
    those meet; beyond, rows are counted along the order, so that a group of any size fills many tasks."""
    keys = ["rank", "t_index"]
    if n is None:
        last = few(chain.groupBy(*keys).agg(F.max("step").alias("step")))
        return chain.join(last, [*keys, "step"])
    if n <= KEPT:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        return chain.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).drop("k")
    c = Ordered(chain, keys, order, rows).running_sum(F.lit(1).cast("long"), "k").df
    return c.where(F.col("k") > F.col("k_all") - n).drop("k", "k_all")


def trim_path(df: DataFrame, skip: int, order: list[str], rows: int | None = None) -> DataFrame:
    """Without the first ``skip`` rows and the last row of each run."""
    d = Ordered(df, ["run"], order, rows).running_sum(F.lit(1).cast("long"), "k").df
    return d.where((F.col("k") > skip) & (F.col("k") < F.col("k_all"))).drop("k", "k_all")


def acceptance_counts(counts: DataFrame) -> DataFrame:
    """Accepted moves of those tried; null where none was tried."""
    return counts.groupBy("t_index").agg(F.try_divide(F.sum("accepted"), F.sum("tried")).alias("acceptance"))


def trial_result_accept(trial: DataFrame, result: DataFrame) -> DataFrame:
    """A move was accepted if the result row has the trial's x, at the same (rank, step, walker)."""
    keys = ["rank", "step", "walker"]
    j = trial.select(*keys, "t_index", F.col("x").alias("tx")).join(result.select(*keys, "x"), keys)
    return j.groupBy("t_index").agg(F.sum((F.col("x") == F.col("tx")).cast("long")).alias("accepted"), F.count(F.lit(1)).alias("tried"))


def data_ranges(df: DataFrame, cols: list[str]) -> list[tuple[float, float]]:
    """Smallest and largest value of each column over all rows; half a unit to each side where they are equal."""
    row = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}{k}") for c in cols for k, f in enumerate((F.min, F.max))]).first()
    pairs = [(row[f"{c}0"], row[f"{c}1"]) for c in cols]
    return [(a - 0.5, b + 0.5) if a == b else (a, b) for a, b in [(0.0, 1.0) if p[0] is None else p for p in pairs]]


def _ranges(df: DataFrame, cols: list[str], ranges) -> list[tuple[float, float]]:
    """ranges: None (that of the data), one pair for all columns, or one pair a column."""
    if ranges is None:
        return data_ranges(df, cols)
    return [tuple(ranges)] * len(cols) if not isinstance(ranges[0], list | tuple) else list(ranges)


def _bin_of(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin of a value in [lo, hi], found by arithmetic and put right against the edges; the last bin is closed."""
    step = (hi - lo) / bins
    edge = lambda k: F.when(k == bins, hi).otherwise(lo + k * step)
    k = F.least(F.floor((v - lo) / step), F.lit(bins - 1))
    return F.when(v < edge(k), k - 1).when((v >= edge(k + 1)) & (k + 1 < bins), k + 1).otherwise(k).cast("int")


def hist1d(df: DataFrame, cols: list[str], bins: int = 60, ranges=None, by: str = "t_index", weight: str | None = None) -> DataFrame:
    """(by, col, bin, w): weighted histograms; weights are divided by the group's total before rows outside are dropped.
    ``ranges`` is None (smallest and largest value of the data), one pair, or one pair a column. A total weight of 0 gives
    null."""
    ranges = _ranges(df, cols, ranges)
    w = F.col(weight) if weight else F.lit(1.0)
    d = df.select(by, w.alias("w"), F.posexplode(F.array(*[F.col(c).cast("double") for c in cols])).alias("col", "v"))
    total = df.groupBy(by).agg(F.sum(w).alias("total"))
    lo, hi = (F.element_at(F.array(*[F.lit(float(r[i])) for r in ranges]), F.col("col") + 1) for i in (0, 1))
    d = d.where((F.col("v") >= lo) & (F.col("v") <= hi)).withColumn("bin", _bin_of(F.col("v"), lo, hi, bins))
    return d.groupBy(by, "col", "bin").agg(F.sum("w").alias("s")).join(total, by).select(by, "col", "bin", F.try_divide("s", "total").alias("w"))


def hist2d(df: DataFrame, a: str, b: str, bins: int, ranges=None, by: str = "t_index", weight: str | None = None) -> DataFrame:
    """(by, bin_a, bin_b, w) of one pair of columns, as in :func:`hist1d`."""
    return hist2d_pairs(df, [a, b], bins, ranges, by, weight).drop("a", "b")


def hist2d_pairs(df: DataFrame, cols: list[str], bins: int = 60, ranges=None, by: str = "t_index", weight: str | None = None, empty: float | None = None) -> DataFrame:
    """(by, a, b, bin_a, bin_b, w) for every pair a < b of the columns' positions, in one pass over the rows. With ``empty``
    all bins * bins cells of each pair and group stand, those without weight with that value."""
    ranges = _ranges(df, cols, ranges)
    w = F.col(weight) if weight else F.lit(1.0)
    total = df.groupBy(by).agg(F.sum(w).alias("total"))
    at = []
    for c, (lo, hi) in zip(cols, ranges, strict=True):
        v = F.col(c).cast("double")
        at.append(F.when((v >= lo) & (v <= hi), _bin_of(v, F.lit(float(lo)), F.lit(float(hi)), bins)))
    pairs = [(i, k) for i in range(len(cols)) for k in range(i + 1, len(cols))]
    d = df.select(by, w.alias("w"), *[x.alias(f"bin{i}") for i, x in enumerate(at)])
    d = d.select(by, "w", F.inline(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(k).alias("b"), F.col(f"bin{i}").alias("bin_a"), F.col(f"bin{k}").alias("bin_b")) for i, k in pairs])))
    d = d.where("bin_a is not null and bin_b is not null").groupBy(by, "a", "b", "bin_a", "bin_b").agg(F.sum("w").alias("s"))
    d = d.join(total, by).select(by, "a", "b", "bin_a", "bin_b", F.try_divide("s", "total").alias("w"))
    if empty is None:
        return d
    # groups times pairs times cells: one row each in the result, made without a join
    cell = F.explode(F.sequence(F.lit(0), F.lit(bins * bins - 1)))
    every = total.select(by, F.inline(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(k).alias("b")) for i, k in pairs]))).withColumn("cell", cell)
    every = every.select(by, "a", "b", F.floor(F.col("cell") / bins).cast("int").alias("bin_a"), (F.col("cell") % bins).cast("int").alias("bin_b"))
    return every.join(d, [by, "a", "b", "bin_a", "bin_b"], "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(float(empty))))


def neal_weights(population: DataFrame, interval: int) -> DataFrame:
    """Adds block and lw: minus the sum of (beta step) * fx over the earlier temperatures of the resampling block."""
    p = population.withColumn("block", F.floor(F.col("t_index") / interval))
    w = Window.partitionBy("walker", "block").orderBy("t_index")
    p = p.withColumn("d", (F.lead("beta").over(w) - F.col("beta")) * F.col("fx"))
    return p.withColumn("lw", -F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("d")


def _shifted(p: DataFrame) -> DataFrame:
    """Adds w: the weight over the largest of its temperature."""
    top = p.groupBy("t_index").agg(F.max("lw").alias("top"))
    return p.join(few(top), "t_index").withColumn("w", F.exp(F.col("lw") - F.col("top")))


def participation_ratio(p: DataFrame) -> DataFrame:
    return _shifted(p).groupBy("t_index").agg((F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("pr"))


def weighted_jackknife(p: DataFrame, is_cut: bool = False) -> DataFrame:
    """Bias-corrected mean and error by leave-one-out means, in closed form: with m = F / W, a walker's mean is
    m - (f - m) w / (W - w), so two grouped passes are enough. Where leaving a walker out leaves no weight (one walker, or
    one with all of it), the mean is not corrected and the error is null. ``p`` is cut once, for all passes, unless it is."""
    p = _shifted(p if is_cut else cut(p.select("t_index", "fx", "lw"), "weights"))
    t = p.groupBy("t_index").agg(F.sum("w").alias("tw"), (F.sum(F.col("w") * F.col("fx")) / F.sum("w")).alias("m"), F.count(F.lit(1)).alias("n"))
    e = p.join(few(t), "t_index").withColumn("e", F.try_divide(-(F.col("fx") - F.col("m")) * F.col("w"), F.col("tw") - F.col("w")))
    g = e.groupBy("t_index").agg(F.first("m").alias("m"), F.first("n").alias("n"), F.count("e").alias("k"), F.avg("e").alias("ae"), F.var_pop("e").alias("ve"))
    whole = F.col("k") == F.col("n")
    return g.select("t_index", F.when(whole, F.col("m") - (F.col("n") - 1) * F.col("ae")).otherwise(F.col("m")).alias("mean"), F.when(whole, F.sqrt((F.col("n") - 1) * F.col("ve"))).alias("err"))


def reweight(p: DataFrame, dbeta: float) -> DataFrame:
    q = p.withColumn("lw", F.col("lw") - F.lit(dbeta) * F.col("fx"))
    top = q.agg(F.max("lw").alias("top"))
    return q.join(F.broadcast(top)).withColumn("w", F.exp(F.col("lw") - F.col("top"))).drop("top")


def metropolis_accept(df: DataFrame, beta: Column, u: Column, hastings: Column | None = None) -> DataFrame:
    """Old or new row: outside and NaN are rejected; p = exp(-beta (new - old)) * hastings; taken when p >= 1 or u < p."""
    p = F.exp(-beta * (F.col("new_fx") - F.col("fx"))) * (hastings if hastings is not None else F.lit(1.0))
    ok = F.col("in_range") & ~F.isnan("new_fx") & ((p >= 1) | (u < p))
    return df.withColumn("accepted", ok).withColumn("x", F.when(ok, F.col("new_x")).otherwise(F.col("x"))).withColumn("fx", F.when(ok, F.col("new_fx")).otherwise(F.col("fx")))


def swap_temperatures(replicas: DataFrame, offset: int, u) -> DataFrame:
    """Neighbouring temperatures (by offset 0 or 1) trade places within ``group`` with probability exp((b_j - b_i)(f_j - f_i))."""
    pair = F.floor((F.col("t_index") + offset) / 2)
    w = Window.partitionBy("group", "pair")
    r = replicas.withColumn("pair", pair).withColumns({"n": F.count(F.lit(1)).over(w), "lo": F.min(F.struct("t_index", "beta", "fx")).over(w), "hi": F.max(F.struct("t_index", "beta", "fx")).over(w)})
    logp = (F.col("hi.beta") - F.col("lo.beta")) * (F.col("hi.fx") - F.col("lo.fx"))
    swap = (F.col("n") == 2) & ((logp >= 0) | (u(F.col("group"), F.col("pair")) < F.exp(logp)))
    new = F.when(swap, F.col("lo.t_index") + F.col("hi.t_index") - F.col("t_index")).otherwise(F.col("t_index"))
    return r.withColumn("new_t_index", new).drop("pair", "n", "lo", "hi")


def _log_mean_exp(df: DataFrame, by: str, v: str, name: str) -> DataFrame:
    """log of the mean of exp(v) in each group, in one pass: sums of exp(v - top) for blocks of v a few units high are put
    together under the highest."""
    level = F.ceil(F.col(v) / 64.0).cast("double")
    part = df.where(F.col(v).isNotNull()).groupBy(by, level.alias("level")).agg(F.sum(F.exp(F.col(v) - level * 64.0)).alias("s"), F.count(F.lit(1)).alias("c"))
    top = F.max("level").over(Window.partitionBy(by))
    part = part.withColumn("top", top)  # a few rows a group
    return part.groupBy(by).agg((F.log(F.sum(F.col("s") * F.exp((F.col("level") - F.col("top")) * 64.0)) / F.sum("c")) + F.first("top") * 64.0).alias(name))


def population_log_z(p: DataFrame, schedule: DataFrame) -> DataFrame:
    """(t_index, logz) of a population with lw and block (:func:`neal_weights`): inside a block the mean weight, from block
    to block the sum of what the earlier blocks gained."""
    s = schedule.select("t_index", (F.lead("beta").over(Window.orderBy("t_index")) - F.col("beta")).alias("db"))
    ends = p.groupBy("block").agg(F.max("t_index").alias("t_index"))
    last = p.drop("db").join(few(ends), ["block", "t_index"]).join(few(s), "t_index").where("db is not null")
    gain = _log_mean_exp(last.withColumn("v", F.col("lw") - F.col("db") * F.col("fx")), "block", "v", "gain")
    # tables of one row a temperature or block
    at = _log_mean_exp(p, "t_index", "lw", "inner").join(p.groupBy("t_index").agg(F.first("block").alias("block")), "t_index")
    base = at.select("block").distinct().join(gain, "block", "left")
    base = base.withColumn("base", F.coalesce(F.sum("gain").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return at.join(base, "block").select("t_index", (F.col("base") + F.col("inner")).alias("logz"))


def population_stats(p: DataFrame, schedule: DataFrame) -> DataFrame:
    """mean, err, n, logz and pr of each temperature of a population with lw and block, which is cut once for all of them."""
    p = cut(p.select("t_index", "block", "fx", "lw"), "population")
    n = _shifted(p).groupBy("t_index").agg(F.count(F.lit(1)).alias("n"), (F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).alias("pr"))
    return weighted_jackknife(p, is_cut=True).join(n, "t_index").join(population_log_z(p, schedule), "t_index").select("t_index", "mean", "err", "n", "logz", "pr")


def optimal_noise(evidence: DataFrame) -> DataFrame:
    """beta of the largest finite evidence (beta, evidence), and sigma = 1 / sqrt(2 beta), infinite at beta 0."""
    e = evidence.where(finite(F.col("evidence")))
    sigma = F.when(F.col("beta") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.sqrt(2 * F.col("beta"))))
    return e.agg(F.max_by("beta", F.struct("evidence", "beta")).alias("beta")).select("beta", sigma.alias("sigma"))


def model_evidence(tstats: DataFrame, volume: float, n_mu: list[float] | None = None, w_mu: list[float] | None = None) -> DataFrame:
    """Adds evidence: logz - log V + (n/2) log beta + sum of (n_mu/2) log w_mu - (n/2) log pi, of data sets with n_mu points
    and weights w_mu, which are divided by their sum; n is the sum of n_mu. Without them, n is the table's own column.
    Null at beta 0, where the logarithm has no value."""
    w = [x / sum(w_mu) for x in w_mu] if w_mu else []
    half = F.lit(sum(n_mu) / 2.0) if n_mu else F.col("n") / 2.0
    data = sum(n / 2.0 * math.log(x) for n, x in zip(n_mu or [], w, strict=True)) if w else 0.0
    return tstats.withColumn("evidence", F.col("logz") - F.log(F.lit(float(volume))) + half * F.log("beta") + F.lit(data) - half * F.log(F.pi()))


def evidence_over_runs(values: DataFrame, value: str = "evidence") -> DataFrame:
    """(t_index, mean, std) over runs: one row a run and temperature comes in."""
    return values.groupBy("t_index").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def fit_quality(fits: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, ss_res, ss_tot, r2) of predictions p of y; r2 is 0 where all y are equal."""
    m = fits.groupBy(by).agg(F.avg("y").alias("a"))
    g = fits.join(few(m), by).groupBy(by).agg(F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("ss_res"), F.sum(F.pow(F.col("y") - F.col("a"), 2)).alias("ss_tot"))
    return g.withColumn("r2", F.when(F.col("ss_tot") == 0, 0.0).otherwise(1 - F.try_divide("ss_res", "ss_tot")))


def prediction_error(fits: DataFrame, by: str = "dataset") -> DataFrame:
    """(by, mse, nmse): mean squared error of p against y, and the same over the variance of y."""
    mse = F.avg(F.pow(F.col("y") - F.col("p"), 2))
    return fits.groupBy(by).agg(mse.alias("mse"), (mse / (F.var_pop("y") + 1e-12)).alias("nmse"))


def grid_minimum(colormap: DataFrame) -> DataFrame:
    """The (id, fx) of the smallest fx; NaN is left out, ties go to the smallest id."""
    return best_row(colormap, ["id"], ["id", "fx"])


def distinct_temperatures(chain: DataFrame, parts: int = 64) -> DataFrame:
    """(value, n): distinct temperatures, those close to the one before (1e-8 + 1e-5 of it) taken together under the
    smallest. The distinct values are numbered range by range, the ranges' ends handed over, so that no task has them all."""
    d = cut(chain.groupBy("temp").agg(F.count(F.lit(1)).alias("n")), "temperatures")
    bounds = sorted(set(d.approxQuantile("temp", [k / parts for k in range(1, parts)] or [0.0], 0.01)))
    chunk = sum(((F.col("temp") >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    w = Window.partitionBy("range").orderBy("temp")
    d = d.withColumn("range", chunk)
    ends = d.groupBy("range").agg(F.max("temp").alias("end"))
    ends = ends.select("range", F.lag("end").over(Window.orderBy("range")).alias("before"))  # one row a range
    d = d.join(few(ends), "range").withColumn("old", F.coalesce(F.lag("temp").over(w), "before"))
    d = d.withColumn("new", F.when(F.col("temp") - F.col("old") <= 1e-8 + 1e-5 * F.abs("old"), 0).otherwise(1)).drop("before")
    d = cut(d, "numbered")
    base = d.groupBy("range").agg(F.sum("new").alias("s"))
    base = base.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    g = F.col("base") + F.sum("new").over(w)
    return d.join(few(base), "range").withColumn("g", g).groupBy("g").agg(F.min("temp").alias("value"), F.sum("n").alias("n")).drop("g")


def union_ranks(tables: list[DataFrame], order: list[str], rows: int | None = None) -> DataFrame:
    """All ranks' rows under dense ids, in order of rank and ``order``."""
    u = tables[0]
    for t in tables[1:]:
        u = u.unionByName(t)
    return Ordered(u, [], ["rank", *order], rows).running_sum(F.lit(1).cast("long"), "id").df.withColumn("id", F.col("id") - 1).drop("id_all")


def continue_schedule(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` (t_index, beta) appended to ``before``: it must begin with the last beta, which stays once."""
    end, start = before.agg(F.max_by("beta", "t_index"), F.max("t_index")).first(), after.agg(F.min_by("beta", "t_index"), F.min("t_index")).first()
    if end[0] != start[0]:
        raise ValueError(f"the schedule ends at {end[0]}, the next one begins at {start[0]}")
    return before.unionByName(after.where(F.col("t_index") > start[1]).withColumn("t_index", F.col("t_index") - start[1] + end[1]))
