"""Gaussian-process surrogate of an objective on a table of candidates: fits of any number of probes, scores, whole searches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch, cut
from meshwalk.operators.runs import _Run, evaluate_batch, fingerprint, table_sum

#: Probes up to which the process holds all of them; beyond, it holds this many inducing points.
MOST_PROBES = 1000
#: Inducing points by whose evidence over all probes the length is chosen.
COARSE = 256
#: Noise of the process that holds all probes, and of the kernel of inducing points.
NOISE = 1e-6
#: Lengths (times the root of the number of axes) and noises that are tried.
LENGTHS, NOISES = 2.0 ** np.arange(-4, 3.5, 0.5), 10.0 ** np.arange(-6, 0.5, 0.5)
#: Places that a task of the fit takes at least, about, tasks that it has at most (each sends a whole matrix a length), and rows
#: that are multiplied at once.
TASK_PROBES, FIT_TASKS, SLAB = 10_000, 48, 2048
#: Different places up to which each is scored once, whatever the number of rows there.
FEW_PLACES = 100_000
SCORED = "id long, mean double, std double, score double"
PROBED = "step long, id long, x array<double>, fx double"


def kernel(a: np.ndarray, b: np.ndarray, length: float) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-0.5 * np.maximum(d2, 0) / length**2)


def lower_inverse(c: np.ndarray) -> np.ndarray:
    """Inverse of a lower triangular matrix, by halves."""
    n = len(c)
    if n <= 64:
        return np.tril(np.linalg.inv(c))
    h, out = n // 2, np.zeros_like(c)
    out[:h, :h], out[h:, h:] = lower_inverse(c[:h, :h]), lower_inverse(c[h:, h:])
    out[h:, :h] = -out[h:, h:] @ (c[h:, :h] @ out[:h, :h])
    return out


def inverse_factor(k: np.ndarray, noise: float) -> np.ndarray:
    """W, lower triangular, with W^T W the inverse of k + noise I."""
    return lower_inverse(np.linalg.cholesky(k + noise * np.eye(len(k))))


class Process:
    """What the two processes share: a mean that is a sum of kernels around centres, on points standardised by the mesh."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        self.mean, self.std = np.asarray(mean, float), np.where(np.asarray(std) > 0, std, 1.0)

    def scale(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.std

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation at the rows of x."""
        k = kernel(self.scale(x), self.x, self.length)
        return self.my + self.sy * (k @ self.a), self.sy * np.sqrt(np.maximum(self._variance(self.w @ k.T), 0))

    def path(self, seed: int, features: int) -> Callable:
        """A function drawn from the posterior (Thompson sampling): a draw of the prior by random cosine features, moved by
        what the probes say against it."""
        r = np.random.default_rng(seed)
        w, b, theta = r.normal(size=(self.x.shape[1], features)) / self.length, r.uniform(0, 2 * np.pi, features), r.normal(size=features)
        prior = lambda z: np.sqrt(2.0 / features) * (np.cos(z @ w + b) @ theta)
        shift = self._shift(prior(self.x), r)
        return lambda x: self.my + self.sy * (prior(self.scale(x)) + kernel(self.scale(x), self.x, self.length) @ shift)


class Surrogate(Process):
    """The process that holds all its probes; the length is chosen by likelihood."""

    def __init__(self, x: np.ndarray, y: np.ndarray, mean: np.ndarray, std: np.ndarray, noise: float = NOISE):
        super().__init__(mean, std)
        self.x, self.y, self.noise = self.scale(x), np.asarray(y, float), noise
        self.refit()

    def refit(self) -> None:
        """Choose the length anew, by the probes so far."""
        self.my, self.sy = self.y.mean(), self.y.std() or 1.0
        z, best = (self.y - self.my) / self.sy, None
        for length in math.sqrt(self.x.shape[1]) * LENGTHS:
            w = inverse_factor(kernel(self.x, self.x, length), self.noise)
            like = -0.5 * ((w @ z) ** 2).sum() + np.log(np.diag(w)).sum()
            if best is None or like > best[0]:
                best = (like, length, w)
        _, self.length, self.w = best
        self._settle()

    def _settle(self) -> None:
        self.my, self.sy = self.y.mean(), self.y.std() or 1.0
        self.a = self.w.T @ (self.w @ ((self.y - self.my) / self.sy))

    def add(self, x: np.ndarray, y: float) -> None:
        """One more probe: a row more in the inverse factor, quadratic in the number of probes; the length stays."""
        q = self.scale(x)[None]
        v = self.w @ kernel(self.x, q, self.length)[:, 0]
        d = math.sqrt(max(1 + self.noise - v @ v, self.noise))
        self.w = np.block([[self.w, np.zeros((len(v), 1))], [-(v @ self.w)[None] / d, np.array([[1 / d]])]])
        self.x, self.y = np.concatenate([self.x, q]), np.append(self.y, y)
        self._settle()

    def _variance(self, v: np.ndarray) -> np.ndarray:
        return 1 - (v * v).sum(axis=0)

    def _shift(self, prior: np.ndarray, r) -> np.ndarray:
        return self.w.T @ (self.w @ ((self.y - self.my) / self.sy - prior))


class Inducing(Process):
    """The process of any number of probes seen through inducing points u: with v = W k(u, x), W W^T inverse to k(u, u), all
    that the probes say is in the sums of v v^T and v y. With all probes as inducing points it is the process of all probes."""

    def __init__(self, u: np.ndarray, length: float, noise: float, squares: np.ndarray, b: np.ndarray, my: float, sy: float, mean: np.ndarray, std: np.ndarray):
        super().__init__(mean, std)
        self.x, self.length, self.noise, self.my, self.sy, self.b = u, length, noise, my, sy, b
        self.w, self.s = inverse_factor(kernel(u, u, length), NOISE), inverse_factor(squares, noise)
        self._settle()

    def _settle(self) -> None:
        self.a = self.w.T @ (self.s.T @ (self.s @ self.b))

    def add(self, x: np.ndarray, y: float) -> None:
        """One more probe: v v^T more in the sums, so their inverse factor is moved by rank one. Values stay standardised by
        the probes of the fit."""
        v = self.w @ kernel(self.x, self.scale(x)[None], self.length)[:, 0]
        p = self.s @ v
        t = np.concatenate([[1.0], 1.0 + np.cumsum(p * p)])
        d, q, seen = np.sqrt(t[1:] / t[:-1]), p / np.sqrt(t[1:] * t[:-1]), np.zeros(len(p))
        s = self.s.copy()
        # rows of C^-1 s, where C C^T = I + p p^T
        for i in range(len(p)):
            s[i] = (s[i] - p[i] * seen) / d[i]
            seen += q[i] * s[i]
        self.s, self.b = s, self.b + v * (y - self.my) / self.sy
        self._settle()

    def refit(self) -> None:
        """Length and inducing points stay: the few probes of a search say little against the many of the fit."""

    def _variance(self, v: np.ndarray) -> np.ndarray:
        return 1 - (v * v).sum(axis=0) + self.noise * ((self.s @ v) ** 2).sum(axis=0)

    def _shift(self, prior: np.ndarray, r) -> np.ndarray:
        drawn = self.s.T @ (self.s @ self.b + math.sqrt(self.noise) * r.normal(size=len(self.b)))
        return self.w.T @ (drawn - self.w @ prior)


def spread_points(x: np.ndarray, n: int) -> np.ndarray:
    """At most n different rows of x, each the farthest from those before it: any first part is spread out, too."""
    take, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(take) < n and far.max() > 0:
        take.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[take[-1]]) ** 2).sum(axis=1))
    return x[take]


def evidence(squares: np.ndarray, b: np.ndarray, n: int, yy: float) -> tuple[float, float]:
    """(bound on the log evidence, noise) of the best noise; the bound charges what the inducing points leave unexplained."""
    lam, q = np.linalg.eigh(squares)
    lam, bt = np.maximum(lam, 0), q.T @ b
    bound = lambda s: -0.5 * (np.log1p(lam / s).sum() + n * math.log(s) + (yy - (bt * bt / (s + lam)).sum()) / s + max(n - lam.sum(), 0.0) / s)
    return max((float(bound(s)), float(s)) for s in NOISES)


def _sums(places: DataFrame, u: np.ndarray, lengths: list[float], scale: Callable, my: float, sy: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums of v v^T and v y over all probes for each length, from ``places`` (x, n, y): how many probes are at x, and the sum of
    their values. A task sends one matrix a length, rows of equal number meet in one task; the driver gets
    len(lengths) * m * (m + 1) numbers."""
    m = len(u)

    def part(batches):
        ws, total = [inverse_factor(kernel(u, u, length), NOISE) for length in lengths], np.zeros((len(lengths), m, m + 1))
        for b in batches:
            for lo in range(0, len(b), SLAB):
                n = b["n"].to_numpy(float)[lo : lo + SLAB]
                x, y = scale(np.stack(b["x"].to_numpy()[lo : lo + SLAB]).astype(float)), (b["y"].to_numpy(float)[lo : lo + SLAB] - n * my) / sy
                for g, length in enumerate(lengths):
                    v = ws[g] @ kernel(u, x, length)
                    total[g, :, :m] += (v * n) @ v.T
                    total[g, :, m] += v @ y
        for g in range(len(lengths)):
            yield pd.DataFrame({"g": g, "i": np.arange(m), "v": list(total[g])})

    def whole(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for g, i, v in zip(b["g"], b["i"], b["v"], strict=True):
                sums[g, i] = sums[g, i] + v if (g, i) in sums else np.array(v, float)
        if sums:
            yield pd.DataFrame({"g": [k[0] for k in sums], "i": [k[1] for k in sums], "v": list(sums.values())})

    schema, out = "g long, i long, v array<double>", np.zeros((len(lengths), m, m + 1))
    for r in places.mapInPandas(part, schema).repartition("g", "i").mapInPandas(whole, schema).collect():
        out[r.g, r.i] = r.v
    return [(o[:, :m], o[:, m]) for o in out]


def fit_inducing(probes: DataFrame, mean: np.ndarray, std: np.ndarray, most: int = MOST_PROBES, coarse: int = COARSE) -> Inducing:
    """The process of all ``probes`` (id, x, y) through at most ``most`` inducing points. These are spread out over a sample of
    8 * ``most`` probes; length, noise and weights come from sums over all probes: a pass for the evidence of every length
    through ``coarse`` points, and one for the length chosen."""
    scratch, scale = Scratch(probes.sparkSession), Process(mean, std).scale
    probes = scratch.cut(probes.select("id", "x", "y"), "probes")
    try:
        n, my, sy = probes.agg(F.count(F.lit(1)), F.avg("y"), F.stddev_pop("y")).first()
        sample = probes.orderBy(F.xxhash64("id"), "id", "x").limit(8 * most).select("x").collect()
        u = spread_points(scale(np.array([r.x for r in sample], float)), most)
        places = scratch.cut(probes.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")), "places")
        scratch.drop("probes")
        spread, yy, sy = places.repartition(min(places.count() // TASK_PROBES + 1, FIT_TASKS)), float(n if sy else 0), sy or 1.0
        lengths = list(math.sqrt(u.shape[1]) * LENGTHS)
        tried = [evidence(s, b, n, yy) for s, b in _sums(spread, u[:coarse], lengths, scale, my, sy)]
        length = lengths[max(range(len(lengths)), key=lambda k: tried[k][0])]
        ((squares, b),) = _sums(spread, u, [length], scale, my, sy)
        return Inducing(u, length, evidence(squares, b, n, yy)[1], squares, b, my, sy, mean, std)
    finally:
        scratch.drop_all()


def fit_surrogate(mesh: DataFrame, observed: DataFrame, most: int = MOST_PROBES) -> tuple[Process, float] | None:
    """(process of -fx, largest -fx) of the rows of ``observed`` (id, fx) that are in ``mesh`` (id, x) and have a finite fx; None
    without such rows. Up to ``most`` probes the process holds all of them, beyond it sees them through inducing points."""
    first = mesh.where(F.col("x").isNotNull()).select(F.size("x")).first()
    if first is None:
        return None
    m = mesh.agg(*[f(F.col("x")[k]) for f in (F.avg, F.stddev_pop) for k in range(first[0])]).first()
    mean, std = np.array(m[: first[0]], float), np.array(m[first[0] :], float)
    finite = observed.where("fx IS NOT NULL AND NOT isnan(fx) AND abs(fx) < double('infinity')").select("id", (-F.col("fx")).alias("y"))
    probes = mesh.where(F.col("x").isNotNull()).select("id", "x").join(finite, "id")
    few = probes.limit(most + 1).collect()
    if not few:
        return None
    if len(few) > most:
        return fit_inducing(probes, mean, std, most), probes.agg(F.max("y")).first()[0]
    few.sort(key=lambda p: (p.id, p.y))
    y = np.array([p.y for p in few], float)
    return Surrogate(np.array([p.x for p in few], float), y, mean, std), y.max()


class NormalTail:
    """Distribution function over density of the normal distribution below 0: a smooth function, by cubics between exact values."""

    STEPS, LOW = 512, -37

    def __init__(self):
        at = np.arange(self.LOW * self.STEPS, 1) / self.STEPS
        self.at, self.value = at, np.array([0.5 * math.erfc(-z / math.sqrt(2)) * math.sqrt(2 * math.pi) * math.exp(z * z / 2) for z in at])
        self.slope = (1 + at * self.value) / self.STEPS

    def __call__(self, z: np.ndarray) -> np.ndarray:
        z = np.clip(z, self.LOW, 0)
        k = np.minimum(((z - self.LOW) * self.STEPS).astype(int), len(self.at) - 2)
        t = (z - self.at[k]) * self.STEPS
        return (1 + 2 * t) * (1 - t) ** 2 * self.value[k] + t * (1 - t) ** 2 * self.slope[k] + t * t * (3 - 2 * t) * self.value[k + 1] + t * t * (t - 1) * self.slope[k + 1]


def scorer(process: Process, top: float, score: str, seed: int, features: int) -> Callable:
    """A function of a matrix of points: mean, standard deviation and score of each."""
    if score not in ("TS", "EI", "PI"):
        raise ValueError("score is TS, EI or PI")
    draw, tail = (process.path(seed, features), None) if score == "TS" else (None, NormalTail())

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mean, std = process.predict(x)
        if draw:
            return mean, std, draw(x)
        sure = std <= 0
        z = (mean - top) / np.where(sure, 1.0, std)
        density, ratio = np.exp(-0.5 * np.minimum(z * z, 1400)) / math.sqrt(2 * math.pi), tail(-np.abs(z))
        if score == "PI":
            return mean, std, np.where(sure, mean > top, np.where(z > 0, 1 - density * ratio, density * ratio))
        # E max(mean - top + std g, 0) at -|z|; for z > 0 it is z more
        return mean, std, np.where(sure, np.maximum(mean - top, 0), std * (density * np.maximum(1 - np.abs(z) * ratio, 0) + np.maximum(z, 0)))

    return run


def _scored(left: DataFrame, run: Callable, schema: str, without: frozenset = frozenset()) -> DataFrame:
    def score(batches):
        for b in (whole[lo : lo + SLAB] for whole in batches for lo in range(0, len(whole), SLAB)):
            b = b[~b["id"].isin(without)] if without else b
            if len(b):
                mean, std, s = run(np.stack(b["x"].to_numpy()).astype(float))
                yield b.assign(mean=mean, std=std, score=s)[[c.split(" ")[0] for c in schema.split(", ")]]

    return left.mapInPandas(score, schema)


def _unseen(mesh: DataFrame, observed: DataFrame) -> DataFrame:
    return mesh.where(F.col("x").isNotNull()).select(F.col("id").cast("long").alias("id"), "x").join(observed.select("id"), "id", "left_anti")


def score_candidates(mesh: DataFrame, observed: DataFrame, score: str = "TS", seed: int = 0, features: int = 2000, most: int = MOST_PROBES) -> DataFrame:
    """(id, mean, std, score) of every row of ``mesh`` (id, x) that is not in ``observed`` (id, fx): posterior of -fx, as the
    search looks for its largest value, and the score TS (a draw of the posterior), EI (expected improvement) or PI
    (probability of it). The next probe is the row of the largest score.

    Points are standardised over the whole mesh. Any number of probes is fitted (:func:`fit_surrogate`). All candidates are
    scored by tasks, in batches; where rows share few places, each place once. Rows of ``observed`` without a finite fx are not fitted, nor scored; without any other, this raises.
    """
    fitted = fit_surrogate(mesh, observed, most)
    if fitted is None:
        raise ValueError("the surrogate needs a probe with a finite value")
    left, run, x = _unseen(mesh, observed), scorer(*fitted, score, seed, features), mesh.where(F.col("x").isNotNull()).select("x")
    if x.agg(F.approx_count_distinct(F.xxhash64("x"))).first()[0] > FEW_PLACES:
        return _scored(left, run, SCORED)
    places = x.distinct().select(F.lit(0).cast("long").alias("id"), "x").repartition(mesh.sparkSession.sparkContext.defaultParallelism)
    scored = cut(_scored(places, run, "x array<double>, mean double, std double, score double"), "scored")
    return left.join(F.broadcast(scored), "x").select("id", "mean", "std", "score")


def next_probe(scores: DataFrame) -> DataFrame:
    """The candidate of the largest score; ties go to the smallest id."""
    columns = [c for c in scores.columns if c in ("id", "x", "score")]
    return scores.where(~F.isnan("score")).agg(F.max_by(F.struct(*columns), F.struct("score", -F.col("id"))).alias("b")).where("b IS NOT NULL").select("b.*")


def surrogate_search(mesh: DataFrame, observed: DataFrame, objective: Callable, rounds: int, folder: str, score: str = "TS", seed: int = 0, features: int = 2000, interval: int = 0, most: int = MOST_PROBES) -> DataFrame:
    """(step, id, x, fx, best_id, best_x, best_fx): ``rounds`` rounds that score all of ``mesh``, evaluate the best candidate and
    take its value into the process, from the probes ``observed`` (id, fx) on; ends early when no candidate is left.

    The fit is made once; a round moves its factor by one probe, and scores the mesh by tasks. With ``interval``, the length
    is chosen anew every so many rounds as long as the process holds all its probes. A round stands in ``folder``: called
    again with as many rounds or more, the search goes on after the last one, and gives what one search gives. Another mesh,
    objective, score, seed or set of probes in the folder is refused. A value that is not finite is in the history, not in the fit.
    ``best_*`` are the smallest value so far, the observed ones included (ties: the earliest, of observed ones the smallest id).
    """
    spark, scratch = mesh.sparkSession, Scratch(mesh.sparkSession)
    fitted = fit_surrogate(mesh, observed, most)
    if fitted is None:
        raise ValueError("the surrogate needs a probe with a finite value")
    process, top = fitted
    facts = {"kind": "surrogate search", "seed": repr(seed), "score": f"{score} {features}", "interval": f"{interval} {most}", "objective": fingerprint(objective), "mesh": table_sum(mesh.select("id", "x")), "observed": table_sum(observed.select("id", "fx"))}
    run = _Run(spark, folder, facts, ["probe"] * rounds, PROBED)
    done, probed = run.done(), []
    left = scratch.cut(_unseen(mesh, observed), "left")
    try:
        for k in range(rounds):
            if interval and k and k % interval == 0:
                process.refit()
            if k < done:
                p = run.read(k).select("step", "id", "x", "fx").first()
            else:
                scores = _scored(left, scorer(process, top, score, seed + k, features), "id long, x array<double>, mean double, std double, score double", frozenset(q.id for q in probed))
                b = next_probe(scores).first()
                if b is None:
                    break
                fx = evaluate_batch(objective, np.array([b.x], float), -np.inf, np.inf)[0]
                run.write(k, spark.createDataFrame([(k, b.id, list(b.x), float(fx))], PROBED).coalesce(1), 1)
                p = run.read(k).select("step", "id", "x", "fx").first()
            probed.append(p)
            if math.isfinite(p.fx):
                process.add(np.array(p.x, float), -p.fx)
                top = max(top, -p.fx)
    finally:
        scratch.drop_all()
    start = observed.where("fx IS NOT NULL AND NOT isnan(fx)").join(mesh.select("id", "x"), "id").agg(F.min_by(F.struct("id", "x", "fx"), F.struct("fx", "id")).alias("b")).first().b
    best, history = (start.id, start.x, start.fx), []
    for p in probed:
        best = (p.id, p.x, p.fx) if p.fx < best[2] else best
        history.append((p.step, p.id, p.x, p.fx, *best))
    return spark.createDataFrame(history, f"{PROBED}, best_id long, best_x array<double>, best_fx double")
