"""Whole runs: sweeps of all walkers, population annealing, replica exchange; each can be resumed and continued.

A run's state is one table a temperature or round in the run's folder. A run looks for the last one that is complete and
goes on from there, so an interrupted run is resumed, and one with a longer plan continued, by the same call. Random numbers
are functions of seed, walker and step, so either gives what one uninterrupted run gives, on any number of partitions.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.functions.rng import normal_array, uniform, uniform_array
from meshwalk.operators import chain as ch
from meshwalk.operators import population as pop

def state_schema(place: str = "array<double>") -> str:
    """State of a walker: where it is, its value, the best it has met."""
    return f"walker long, t_index long, beta double, x {place}, fx double, lw double, ancestor long, best_fx double, best_x {place}"


def moved_schema(place: str = "array<double>") -> str:
    """A walker after a step, with its last trial and the number of accepted moves."""
    return f"{state_schema(place)}, step long, trial_x {place}, trial_fx double, accepted boolean, naccepted long"


STATE, MOVED = state_schema(), moved_schema()
#: Draws for a starting point that is not allowed, before the run gives up.
MAX_TRIES = 100


def evaluate_batch(objective: Callable, x: np.ndarray, mins, maxs, allowed=None, ignore_error: bool = False) -> np.ndarray:
    """Values of the rows of x; infinity outside the closed box or where not ``allowed``. An error of the objective is raised,
    or with ``ignore_error`` the batch is tried row by row and failing rows get NaN."""
    ok = ((x >= mins) & (x <= maxs)).all(axis=1)
    if allowed is not None:
        ok &= np.asarray(allowed(x), bool)
    out = np.full(len(x), np.inf)
    if not ok.any():
        return out
    try:
        out[ok] = objective(x[ok])
    except Exception:
        if not ignore_error:
            raise
        for k in np.flatnonzero(ok):
            try:
                out[k] = objective(x[k : k + 1])[0]
            except Exception:
                out[k] = np.nan
    return out


def _with_nan(df: DataFrame) -> DataFrame:
    """NaN, which comes back from pandas as null."""
    return df.withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in ("fx", "best_fx", "trial_fx") if c in df.columns})


def start_walkers(points: DataFrame, objective: Callable, beta: float, t_index: int = 0, ignore_error: bool = False, mins=None, maxs=None, allowed=None, seed: int = 0) -> DataFrame:
    """Walkers (walker, x) with their values, weight 1, themselves as ancestors. With a box, starting points outside of it,
    and those that are not ``allowed``, are drawn anew in the box until they are; after ``MAX_TRIES`` draws this raises."""

    def settled(w: np.ndarray, x: np.ndarray) -> np.ndarray:
        if mins is None:
            return x
        lo, hi, axes = np.array(mins, float), np.array(maxs, float), np.arange(x.shape[1])
        for k in range(MAX_TRIES + 1):
            ok = ((x >= lo) & (x <= hi)).all(axis=1)
            if allowed is not None:
                ok &= np.asarray(allowed(x), bool)
            bad = np.flatnonzero(~ok)
            if not len(bad):
                return x
            x[bad] = lo + (hi - lo) * uniform_array(seed, np.repeat(w[bad], len(axes)), k, np.tile(axes, len(bad)), 9).reshape(len(bad), -1)
        raise ValueError(f"{len(bad)} starting points are not allowed after {MAX_TRIES} draws")

    def run(batches):
        for b in batches:
            x = settled(b["walker"].to_numpy(), np.stack(b["x"].to_numpy()).astype(float)) if len(b) else np.empty((0, 1))
            fx = evaluate_batch(objective, x, -np.inf, np.inf, None, ignore_error) if len(b) else np.empty(0)
            yield pd.DataFrame({"walker": b["walker"], "t_index": t_index, "beta": float(beta), "x": list(x), "fx": fx, "lw": 0.0, "ancestor": b["walker"], "best_fx": fx, "best_x": list(x)})

    return _with_nan(points.select("walker", "x").mapInPandas(run, STATE))


def sweep(walkers: DataFrame, objective: Callable, sizes: list[float], seed: int, steps: range, mins: list[float], maxs: list[float], allowed=None, every: bool = False, ignore_error: bool = False) -> DataFrame:
    """``steps`` Metropolis steps of every walker (columns STATE) at its own beta, whole batches at a time: no shuffle and one
    pass, however many steps. Proposals outside the box or not allowed, and NaN, are rejected; from NaN every move is taken.

    Returns each walker after the last step with its last trial and the number of accepted moves; with ``every`` after each
    step, which is the log of trials and results. ``objective`` gets a matrix of points and returns their values.
    """
    lo, hi, size = np.array(mins, float), np.array(maxs, float), np.array(sizes, float)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            w, beta, x, fx = b["walker"].to_numpy(), b["beta"].to_numpy(), np.stack(b["x"].to_numpy()).astype(float), b["fx"].to_numpy(float).copy()
            best_fx, best_x, n = b["best_fx"].to_numpy(float).copy(), np.stack(b["best_x"].to_numpy()).astype(float), np.zeros(len(b), np.int64)
            axes = np.arange(x.shape[1])
            for s in steps:
                y = x + size * normal_array(seed, np.repeat(w, len(axes)), s, np.tile(axes, len(w))).reshape(x.shape)
                fy = evaluate_batch(objective, y, lo, hi, allowed, ignore_error)
                with np.errstate(over="ignore", invalid="ignore"):
                    p = np.exp(-beta * (fy - np.where(np.isnan(fx), np.inf, fx)))
                ok = np.isfinite(fy) & ((p >= 1) | (uniform_array(seed, w, s, 3) < p))
                x, fx, n = np.where(ok[:, None], y, x), np.where(ok, fy, fx), n + ok
                better = ~(fx >= best_fx)
                best_fx, best_x = np.where(better, fx, best_fx), np.where(better[:, None], x, best_x)
                if every or s == steps[-1]:
                    out = b.assign(x=list(x), fx=fx, best_fx=best_fx, best_x=list(best_x), step=s, trial_x=list(y), trial_fx=fy, accepted=ok, naccepted=n)
                    yield out[[c.split(" ")[0] for c in MOVED.split(", ")]]

    if not len(steps):
        none = [F.lit(-1).cast("long").alias("step"), F.col("x").alias("trial_x"), F.col("fx").alias("trial_fx"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("naccepted")]
        return walkers.select(*[c.split(" ")[0] for c in STATE.split(", ")], *none)
    return _with_nan(walkers.select(*[c.split(" ")[0] for c in STATE.split(", ")]).mapInPandas(run, MOVED))


def fingerprint(f: Callable | None) -> str:
    """What a function does, as far as it can be told: its code, constants, defaults and the values it closes over."""
    if f is None:
        return "none"
    h = hashlib.sha256()

    def add(v) -> None:
        if hasattr(v, "co_code"):
            h.update(v.co_code + repr(v.co_names).encode())
            for c in v.co_consts:
                add(c)
        elif isinstance(v, np.ndarray):
            h.update(v.tobytes())
        elif callable(v) and hasattr(v, "__code__"):
            add(v.__code__)
            for c in [*(v.__defaults__ or ()), *(c.cell_contents for c in v.__closure__ or ())]:
                add(c)
        else:
            h.update((getattr(v, "__qualname__", "") or repr(v)).encode())

    add(f)
    return h.hexdigest()[:16]


def table_sum(df: DataFrame) -> str:
    """Number of rows and sum of their hashes: the same for the same rows, however they are stored."""
    return ":".join(str(v) for v in df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


class _Run:
    """Tables of a run, one a temperature or round, under a manifest of what the run is.

    The manifest tells seed, box, step sizes, objective, constraint, starting points and the plan so far: a run that goes on
    must have the same, and a plan that begins like it. It is created once, so of two different runs in a folder the
    second one is refused. Each table has its sum beside it: a damaged one is made again, with those after it.
    """

    def __init__(self, spark: SparkSession, folder: str, facts: dict[str, str], plan: list[str], schema: str):
        self.spark, self.folder, self.schema = spark, folder, schema
        text = json.dumps({"facts": facts, "plan": plan}, indent=1)
        if self._create("manifest.json", text):
            return
        was = json.loads(self._read("manifest.json"))
        for name in sorted({*facts, *was["facts"]}):
            if facts.get(name) != was["facts"].get(name):
                raise ValueError(f"the run in {folder} has another {name}")
        shared = min(len(plan), len(was["plan"]))
        if plan[:shared] != was["plan"][:shared]:
            raise ValueError(f"the run in {folder} follows another plan")
        if len(plan) > len(was["plan"]):
            self._create("manifest.json", text, overwrite=True)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _is_there(self, name: str) -> bool:
        p, fs = self._path(name)
        return fs.exists(p)

    def _create(self, name: str, text: str, overwrite: bool = False) -> bool:
        p, fs = self._path(name)
        if not overwrite and fs.exists(p):
            return False
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _read(self, name: str) -> str:
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]

    def path(self, k: int) -> str:
        return f"{self.folder}/state/k={k}"

    def done(self) -> int:
        """Number of tables that are complete, as they were written, up to the first that is not."""
        k = 0
        while self._is_there(f"state/k={k}/_SUCCESS") and self._is_there(f"sums/k={k}") and self._read(f"sums/k={k}") == self._sum(k):
            k += 1
        return k

    def _sum(self, k: int) -> str:
        try:
            return table_sum(self.read(k))
        except Exception as e:  # a file that cannot be read is a damaged table
            return f"unreadable: {type(e).__name__}"

    def read(self, k: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, ntrial long").parquet(self.path(k))

    def write(self, k: int, df: DataFrame, ntrial: int) -> None:
        df.withColumn("ntrial", F.lit(ntrial).cast("long")).write.mode("overwrite").parquet(self.path(k))
        self._create(f"sums/k={k}", table_sum(self.read(k)), overwrite=True)

    def all(self, n: int) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, ntrial long").parquet(*[self.path(k) for k in range(n)])


class Box:
    """Points of a closed box, moved by normal steps; values of an objective of matrices, infinite where not ``allowed``."""

    place = "array<double>"

    def __init__(self, objective: Callable, sizes: list[float], mins: list[float], maxs: list[float], allowed=None, ignore_error: bool = False):
        self.objective, self.sizes, self.mins, self.maxs, self.allowed, self.ignore_error = objective, sizes, mins, maxs, allowed, ignore_error

    def facts(self) -> dict[str, str]:
        numbers = lambda v: repr([float(x) for x in v])
        return {"box": numbers(self.mins) + numbers(self.maxs), "step sizes": numbers(self.sizes), "objective": fingerprint(self.objective), "constraint": fingerprint(self.allowed)}

    def start(self, points: DataFrame, beta: float, seed: int) -> DataFrame:
        return start_walkers(points, self.objective, beta, 0, self.ignore_error, self.mins, self.maxs, self.allowed, seed)

    def sweep(self, walkers: DataFrame, seed: int, steps: range) -> DataFrame:
        return sweep(walkers, self.objective, self.sizes, seed, steps, self.mins, self.maxs, self.allowed, ignore_error=self.ignore_error)


def anneal_in(space, points: DataFrame, betas: list[float], nsteps: list[int], seed: int, folder: str, interval: int = 1, fixed: bool = True) -> DataFrame:
    """Population annealing in any space that starts and sweeps walkers (:class:`Box`, a mesh); see :func:`anneal`."""
    spark = points.sparkSession
    facts = {"kind": "annealing", "seed": repr(seed), "resampling": f"{'fixed' if fixed else 'varied'} every {interval}", "starting points": table_sum(points.select("walker", "x"))} | space.facts()
    run = _Run(spark, folder, facts, [f"{float(b)!r} {n}" for b, n in zip(betas, nsteps, strict=True)], moved_schema(space.place))
    for k in range(run.done(), len(betas)):
        begin = 1 + sum(nsteps[:k])
        if k == 0:
            p = space.start(points, betas[0], seed)
        else:
            p = run.read(k - 1).withColumn("lw", F.col("lw") - F.lit(betas[k] - betas[k - 1]) * F.col("fx"))
            if k % interval == 0:
                best = p.agg(F.min_by(F.struct("best_fx", "best_x"), F.struct("best_fx", "walker")).alias("b")).select("b.*")
                q = p.select("walker", "x", "fx", "lw", "ancestor")
                q = pop.fixed_population(q, seed, k) if fixed else pop.varied_population(q, run.read(0).count(), seed, k)
                # the run's best is kept by every walker: its own ones may die out
                p = q.drop("parent").join(F.broadcast(best))  # one row
            p = p.withColumns({"t_index": F.lit(k).cast("long"), "beta": F.lit(float(betas[k]))})
        run.write(k, space.sweep(p, seed, range(begin, begin + nsteps[k])), nsteps[k])
    return run.all(len(betas))


def anneal(points: DataFrame, objective: Callable, betas: list[float], nsteps: list[int], sizes: list[float], mins: list[float], maxs: list[float], seed: int, folder: str, interval: int = 1, fixed: bool = True, allowed=None, ignore_error: bool = False) -> DataFrame:
    """Population annealing of the walkers of ``points`` (walker, x): at each beta ``nsteps`` steps of all walkers; between
    them the weights take the change of beta, and every ``interval`` temperatures the population is drawn anew (to its own
    size, or with ``fixed=False`` to Poisson numbers about its first size).

    Returns the walkers after each temperature (columns MOVED and ntrial; t_index, beta, fx, lw, ancestor, naccepted ...).
    The run lives in ``folder``: called again, it goes on after the last complete temperature, and with more betas it
    continues; both equal one run. Called with another box, objective, constraint, seed or other starting points, it raises
    and names what has changed. :func:`anneal_stats` gives the statistics.
    """
    return anneal_in(Box(objective, sizes, mins, maxs, allowed, ignore_error), points, betas, nsteps, seed, folder, interval, fixed)


def anneal_stats(states: DataFrame, interval: int = 1) -> DataFrame:
    """(t_index, beta, mean, err, n, logz, pr, acceptance) of the walkers that :func:`anneal` returns."""
    p = states.withColumn("block", F.floor(F.col("t_index") / interval))
    s = p.groupBy("t_index").agg(F.first("beta").alias("beta"), F.try_divide(F.sum("naccepted"), F.sum("ntrial")).alias("acceptance"))
    stats = ch.population_stats(p.select("t_index", "block", "fx", "lw"), s.select("t_index", "beta"))
    return stats.join(s, "t_index").select("t_index", "beta", "mean", "err", "n", "logz", "pr", "acceptance")


def exchange_in(space, points: DataFrame, betas: list[float], rounds: int, every: int, seed: int, folder: str) -> DataFrame:
    """Replica exchange in any space that starts and sweeps walkers; see :func:`replica_exchange`."""
    spark, m = points.sparkSession, len(betas)
    facts = {"kind": "exchange", "seed": repr(seed), "temperatures": repr([float(b) for b in betas]), "steps a round": repr(every), "starting points": table_sum(points.select("group", "x"))} | space.facts()
    run = _Run(spark, folder, facts, [str(every)] * rounds, moved_schema(space.place))
    beta = F.element_at(F.array(*[F.lit(float(b)) for b in betas]), (F.col("t_index") + 1).cast("int"))
    for k in range(run.done(), rounds):
        if k == 0:
            p = points.select(F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("t"), "group", "x").select((F.col("group") * m + F.col("t")).alias("walker"), "x")
            p = space.start(p, 0.0, seed).withColumn("t_index", F.pmod("walker", F.lit(m)).cast("long")).withColumn("beta", beta)
        else:
            p = run.read(k - 1).withColumn("group", F.floor(F.col("walker") / m))
            p = ch.swap_temperatures(p, (k + 1) % 2, lambda g, pair, k=k: uniform(seed, g, pair, k)).withColumn("t_index", F.col("new_t_index")).withColumn("beta", beta)
        run.write(k, space.sweep(p, seed, range(1 + k * every, 1 + (k + 1) * every)), every)
    return run.all(rounds)


def replica_exchange(points: DataFrame, objective: Callable, betas: list[float], rounds: int, every: int, sizes: list[float], mins: list[float], maxs: list[float], seed: int, folder: str, allowed=None, ignore_error: bool = False) -> DataFrame:
    """Replica exchange of many independent groups at once: ``points`` are (group, x), one replica of each group at every
    beta. A round is ``every`` steps of all replicas; before every round but the first, neighbouring temperatures of a group
    may swap, even and odd pairs by turns.

    Returns the replicas after each round (columns MOVED and ntrial; step tells the round's last step). Resumes and
    continues like :func:`anneal`, with more rounds, and is checked alike.
    """
    return exchange_in(Box(objective, sizes, mins, maxs, allowed, ignore_error), points, betas, rounds, every, seed, folder)
