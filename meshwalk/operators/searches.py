"""Searches from many starts at once: simplex minimisation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from meshwalk.operators.chain import best_row
from meshwalk.operators.runs import evaluate_batch

#: Fixed values of the simplex method: reflection, expansion, contraction, shrinking.
REFLECT, EXPAND, CONTRACT, SHRINK = 1.0, 2.0, 0.5, 0.5
FOUND = "id long, x array<double>, fx double, iterations long, evaluations long, converged boolean, simplex array<array<double>>, simplex_fx array<double>"
LOGGED = "id long, kind string, step long, x array<double>, fx double"
#: Rows of a log that a task collects before it sends them on.
LOG_ROWS = 10_000


class Simplexes:
    """Nelder-Mead searches of n simplexes (n, d + 1, d) in step: each iteration evaluates the trial points of all searches that
    still run together. A state that is handed in (values, iterations, evaluations) goes on where it stopped."""

    def __init__(self, v: np.ndarray, fv: np.ndarray | None = None, its: np.ndarray | None = None, fev: np.ndarray | None = None):
        n, self.d = len(v), v.shape[2]
        self.v, self.fv = v.copy(), None if fv is None else fv.copy()
        self.its, self.fev = (np.zeros(n, np.int64) if a is None else a.copy() for a in (its, fev))
        self.ok = np.zeros(n, bool)

    def advance(self, f: Callable, xatol: float, fatol: float, maxiter: int, maxfev: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Search until converged or out of iterations or evaluations, both counted over all parts of a search. Yields what
        happens: ("evaluation", searches, points, values) for each batch of trial points, ("start", searches, points, values)
        of the points the searches start from, and ("iteration", searches, best points, best values)."""
        v, its, fev, live = self.v, self.its, self.fev, np.arange(len(self.v))

        def at(rows: np.ndarray, x: np.ndarray) -> Iterator:
            out = f(x)
            fev[rows] += 1
            yield "evaluation", rows, x, out
            return out

        if self.fv is None:
            self.fv = np.empty(v.shape[:2])
            for k in range(v.shape[1]):
                self.fv[:, k] = yield from at(live, v[:, k])
            yield "start", live, v[:, 0].copy(), self.fv[:, 0].copy()
        fv = self.fv
        while True:
            order = np.argsort(fv[live], axis=1, kind="stable")
            v[live], fv[live] = np.take_along_axis(v[live], order[:, :, None], 1), np.take_along_axis(fv[live], order, 1)
            going = live[its[live] > 0]
            if len(going):
                yield "iteration", going, v[going, 0], fv[going, 0]
            with np.errstate(invalid="ignore"):
                near = (np.abs(v[live, 1:] - v[live, :1]).max(axis=(1, 2)) <= xatol) & (np.abs(fv[live, 1:] - fv[live, :1]).max(axis=1) <= fatol)
            self.ok[live[near]] = True
            live = live[~near & (its[live] < maxiter) & (fev[live] < maxfev)]
            if not len(live):
                return
            its[live] += 1
            low, second, high = fv[live, 0], fv[live, -2], fv[live, -1]
            mid, worst = v[live, :-1].mean(axis=1), v[live, -1]
            r = mid + REFLECT * (mid - worst)
            fr = yield from at(live, r)
            # one more point each: expansion, outside or inside contraction
            grow, shrunk = fr < low, fr >= second
            outside = shrunk & (fr < high)
            t = np.where(grow[:, None], mid + REFLECT * EXPAND * (mid - worst), np.where(outside[:, None], mid + CONTRACT * REFLECT * (mid - worst), mid - CONTRACT * (mid - worst)))
            ft, more = np.full(len(live), np.inf), grow | shrunk
            if more.any():
                ft[more] = yield from at(live[more], t[more])
            take_t = (grow & (ft < fr)) | (outside & (ft <= fr)) | (shrunk & ~outside & (ft < high))
            take_r = ~take_t & ~shrunk
            v[live[take_t], -1], fv[live[take_t], -1] = t[take_t], ft[take_t]
            v[live[take_r], -1], fv[live[take_r], -1] = r[take_r], fr[take_r]
            s = live[~take_t & ~take_r]
            if len(s):
                v[s, 1:] = v[s, :1] + SHRINK * (v[s, 1:] - v[s, :1])
                for k in range(1, v.shape[1]):
                    fv[s, k] = yield from at(s, v[s, k])


def _inside(lo: np.ndarray, hi: np.ndarray, allowed) -> Callable:
    def inside(x: np.ndarray) -> np.ndarray:
        ok = ((x >= lo) & (x <= hi)).all(axis=1)
        return ok & np.asarray(allowed(x), bool) if allowed is not None else ok

    return inside


def _open_box(mins: list[float], maxs: list[float]) -> tuple[np.ndarray, np.ndarray]:
    return np.nextafter(np.array(mins, float), np.inf), np.nextafter(np.array(maxs, float), -np.inf)


def _first(b: pd.DataFrame, scales: np.ndarray) -> Simplexes:
    x0 = np.stack(b["x"].to_numpy()).astype(float)
    return Simplexes(np.concatenate([x0[:, None], x0[:, None] + np.diag(scales)[None]], axis=1))


def _found(ids: pd.Series, s: Simplexes) -> pd.DataFrame:
    return pd.DataFrame({"id": ids.to_numpy(), "x": list(s.v[:, 0]), "fx": s.fv[:, 0], "iterations": s.its, "evaluations": s.fev, "converged": s.ok, "simplex": [list(v) for v in s.v], "simplex_fx": list(s.fv)})


def multistart_simplex(starts: DataFrame, objective: Callable, scales: list[float], mins: list[float], maxs: list[float], xatol: float = 1e-4, fatol: float = 1e-4, maxiter: int = 10_000, maxfev: int = 100_000, allowed=None, ignore_error: bool = False) -> DataFrame:
    """(id, x, fx, iterations, evaluations, converged, simplex, simplex_fx): one search from each of ``starts`` (id, x), whose
    first simplex is the start and the start moved by ``scales`` along each axis. Points on the border or outside of the box
    and points that are not allowed count as infinite. Starts are independent rows: no shuffle."""
    (lo, hi), size = _open_box(mins, maxs), np.array(scales, float)

    def run(batches):
        f = lambda x: evaluate_batch(objective, x, lo, hi, allowed, ignore_error)
        for b in batches:
            if len(b):
                s = _first(b, size)
                for _ in s.advance(f, xatol, fatol, maxiter, maxfev):
                    pass
                yield _found(b["id"], s)

    return starts.select("id", "x").mapInPandas(run, FOUND)


def continue_simplex(found: DataFrame, objective: Callable, mins: list[float], maxs: list[float], xatol: float = 1e-4, fatol: float = 1e-4, maxiter: int = 10_000, maxfev: int = 100_000, allowed=None, ignore_error: bool = False) -> DataFrame:
    """The searches of ``found`` (as :func:`multistart_simplex` returns them) go on from their last simplexes, whose points are
    not evaluated again. Limits count all parts, so a search in parts gives what one search gives."""
    lo, hi = _open_box(mins, maxs)

    def run(batches):
        f = lambda x: evaluate_batch(objective, x, lo, hi, allowed, ignore_error)
        for b in batches:
            if len(b):
                fv = np.stack(b["simplex_fx"].to_numpy()).astype(float)
                s = Simplexes(np.array([np.stack(v) for v in b["simplex"]], float), fv, b["iterations"].to_numpy(np.int64), b["evaluations"].to_numpy(np.int64))
                for _ in s.advance(f, xatol, fatol, maxiter, maxfev):
                    pass
                yield _found(b["id"], s)

    return found.select("id", "simplex", "simplex_fx", "iterations", "evaluations").mapInPandas(run, FOUND)


def simplex_log(starts: DataFrame, objective: Callable, scales: list[float], mins: list[float], maxs: list[float], xatol: float = 1e-4, fatol: float = 1e-4, maxiter: int = 10_000, maxfev: int = 100_000, allowed=None, ignore_error: bool = False) -> DataFrame:
    """(id, kind, step, x, fx), the histories of the searches of :func:`multistart_simplex`. ``iteration``: the start (step 0) and
    the best point after each iteration. ``evaluation``: every evaluated point, numbered from 1; points outside the box or
    not allowed are not evaluated, so they are not in it. Rows are sent on as the searches go, of any length each."""
    (lo, hi), size = _open_box(mins, maxs), np.array(scales, float)
    inside = _inside(lo, hi, allowed)

    def run(batches):
        f = lambda x: evaluate_batch(objective, x, lo, hi, allowed, ignore_error)
        for b in batches:
            if not len(b):
                continue
            s, ids, calls, parts, held = _first(b, size), b["id"].to_numpy(), np.zeros(len(b), np.int64), [], 0
            for kind, rows, x, fx in s.advance(f, xatol, fatol, maxiter, maxfev):
                step = s.its[rows]
                if kind == "evaluation":
                    ok = inside(x)
                    rows, x, fx = rows[ok], x[ok], fx[ok]
                    calls[rows] += 1
                    step = calls[rows]
                parts.append(pd.DataFrame({"id": ids[rows], "kind": "evaluation" if kind == "evaluation" else "iteration", "step": step, "x": list(x), "fx": fx}))
                held += len(rows)
                if held >= LOG_ROWS:
                    yield pd.concat(parts)
                    parts, held = [], 0
            if held:
                yield pd.concat(parts)

    return starts.select("id", "x").mapInPandas(run, LOGGED)


def best_start(found: DataFrame) -> DataFrame:
    """The search with the smallest value; ties go to the smallest id."""
    return best_row(found, ["id"], ["id", "x", "fx"])
