"""Pairs within a radius in any number of dimensions, by cells around pivots.

A cell holds the points that are nearest to its pivot (its own) and, as guests, points of other cells that lie within the
radius of the plane half way to them: no pair within the radius is parted. Full cells are split by pivots of their own, as
often as a split spares distances.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch
from meshwalk.operators.ordered import few

#: Own points of a cell up to which it is left whole, and rows of one side that meet in one task.
CELL_POINTS = 2_000
#: Bytes of coordinates of one side that meet in one task, at most, where a cell has more rows than ``PARTS`` parts of it.
SIDE_BYTES, PARTS = 24 << 20, 8
#: Points of a full cell, about, that choose its pivots, and most pivots of one split. Every point is then dealt by them.
SAMPLE, PIVOTS = 1_000, 32
#: Rows of a cell, about, that one task deals to its new cells.
DEALT = 50_000
#: A split is made only if it leaves at most this share of the distances.
WORTH = 0.7


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows, good to rounding; what is decided by them has a margin."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2.0 * (x @ p.T), 0.0))


def _reach(x: np.ndarray, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's nearest pivot, the cells it may have partners in (a matrix), and its distances to the pivots."""
    d, between = _distances(x, p), _distances(p, p)
    home = d.argmin(1)
    near = d[np.arange(len(x)), home]
    # a partner in another cell lies behind the plane half way between the pivots, so that plane is within the radius
    gap = (d * d - (near * near)[:, None]) / (2.0 * np.maximum(between[home], 1e-300))
    reach = gap <= radius + 1e-6 * (1.0 + radius + d.max(initial=0.0))
    reach[np.arange(len(x)), home] = True
    return home, reach, d


def choose_pivots(x: np.ndarray, radius: float, most: int = PIVOTS) -> np.ndarray:
    """Rows of ``x`` more than a radius apart, taken in the given order, as many as spare most distances among ``x``; one row
    if no number of them leaves at most ``WORTH`` of the distances."""
    taken = x[:1]
    for row in x[1:]:
        if len(taken) == most:
            break
        if _distances(row[None], taken).min() > radius:
            taken = np.concatenate([taken, row[None]])
    best, cost = taken[:1], WORTH
    for k in sorted({2, 4, 8, 16, len(taken)}):
        if k <= len(taken):
            home, reach, _ = _reach(x, taken[:k], radius)
            own = np.bincount(home, minlength=k)
            guests = (reach & (np.arange(k)[None] < home[:, None])).sum(0)
            share = float((own * (own / 2.0 + guests)).sum() / (len(x) ** 2 / 2.0))
            if share <= cost:
                best, cost = taken[:k], share
    return best


class Cells:
    """``rows``: (id, x, own, cell) of points (id, x) dealt to cells for a radius; ``sizes``: (cell, own, guests).

    Points without an id, or with a null or non-finite component, take no part. A cell is a path of pivots ("0.3.12"). Points that all lie
    within a radius of each other, or that pivots cannot part, stay in one cell of any size: :meth:`pairs` deals it to blocks.
    """

    def __init__(self, points: DataFrame, radius: float, cell_points: int = CELL_POINTS):
        self.radius, self.cell_points, self.tables = float(radius), cell_points, Scratch(points.sparkSession)
        p = points.where(F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))))
        now = p.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.lit(True).alias("own"), F.lit("0").alias("cell"), F.lit(False).alias("settled"))
        now, level = self.tables.cut(now, "level"), 0
        while True:
            sizes = now.groupBy("cell", "settled").agg(F.count_if("own").alias("own"), F.count_if(~F.col("own")).alias("guests"))
            sizes = self.tables.cut(sizes, "sizes")
            full = sizes.where(~F.col("settled") & (F.col("own") > cell_points)).select(F.col("cell").alias("c"), F.col("own").alias("n"), (F.col("own") + F.col("guests")).alias("rows"))
            if full.isEmpty():
                break
            now = self.tables.cut(self._split(now, few(full), level), "level")
            level += 1
        self.rows, self.sizes = now.drop("settled"), sizes.drop("settled")

    def _split(self, now: DataFrame, full: DataFrame, level: int) -> DataFrame:
        radius = self.radius
        here = now.join(full, now["cell"] == full["c"], "left").drop("c")
        u = F.xxhash64("id", F.lit(level)) / F.lit(2.0**64) + 0.5
        sample = here.where(F.col("own") & (u < F.lit(float(SAMPLE)) / F.col("n"))).select("cell", "id", "x", F.xxhash64("id").alias("h"))

        def fit(rows: pd.DataFrame) -> pd.DataFrame:
            x = np.array(rows.sort_values(["h", "id"])["x"].to_list(), dtype=float)
            return pd.DataFrame({"cell": [rows["cell"].iloc[0]], "pivots": [list(choose_pivots(x, radius).ravel())]})

        pivots = self.tables.cut(sample.groupBy("cell").applyInPandas(fit, "cell string, pivots array<double>"), "pivots")

        def deal(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
            out = ["id", "x", "own", "cell", "settled"]
            if not len(rows):
                return pd.DataFrame(columns=out)
            x = np.array(rows["x"].to_list(), dtype=float)
            p = np.asarray(pivots["pivots"].iloc[0], dtype=float).reshape(-1, x.shape[1]) if len(pivots) else x[:1]
            if len(p) < 2:
                return rows.assign(settled=True)[out]
            own = rows["own"].to_numpy()
            home, reach, _ = _reach(x, p, radius)
            # each pair of own points is met once: a point visits cells of smaller numbers only; guests visit all in reach
            reach &= ~own[:, None] | (np.arange(len(p))[None] <= home[:, None])
            at, cell = np.nonzero(reach)
            made = rows.iloc[at]
            return made.assign(own=own[at] & (cell == home[at]), cell=[f"{c}.{k}" for c, k in zip(made["cell"], cell, strict=True)], settled=False)[out]

        parts = F.ceil(F.col("rows") / DEALT).cast("int")
        a = here.where("rows IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("id", F.lit(-1)), parts).cast("int")).drop("n", "rows")
        b = pivots.join(full, pivots["cell"] == full["c"]).select("cell", "pivots", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        dealt = a.groupBy("cell", "part").cogroup(b.groupBy("cell", "part")).applyInPandas(deal, "id long, x array<double>, own boolean, cell string, settled boolean")
        return here.where("rows IS NULL").drop("n", "rows").unionByName(dealt)

    def candidates(self) -> DataFrame:
        """(cell, own, guests, pairs): the pairs whose distance a cell may have to measure."""
        own = F.col("own")
        return self.sizes.where("own > 0").select("cell", "own", "guests", (own * (own - 1) / 2 + own * F.col("guests")).cast("long").alias("pairs"))

    def parts(self) -> DataFrame:
        """(c, pa, pb): into how many parts each cell's own rows, and all of its rows, are dealt: by ``cell_points``, at most
        ``PARTS`` unless they have more than ``SIDE_BYTES`` then."""
        dim = self.rows.agg(F.max(F.size("x"))).first()[0] or 1
        most = max(self.cell_points, SIDE_BYTES // (8 * dim))
        parts = lambda rows: F.greatest(F.least(F.ceil(rows / self.cell_points), F.lit(PARTS)), F.ceil(rows / most)).cast("int")
        return self.sizes.where("own > 0").select(F.col("cell").alias("c"), parts(F.col("own")).alias("pa"), parts(F.col("own") + F.col("guests")).alias("pb"))

    def pairs(self) -> DataFrame:
        """(src, dst) of different points within the radius, each pair once, in either order. A cell's sides are dealt to
        :meth:`parts`, and every two parts meet in a task of their own: a row travels once for each part of the other side."""
        radius = self.radius
        size = few(self.parts())
        r = self.rows.join(size, self.rows["cell"] == size["c"]).drop("c")
        part = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        a = r.where("own").select("cell", part("pa", 1).alias("i"), every("pb").alias("j"), "id", "x", F.lit(True).alias("left"), "own")
        b = r.select("cell", every("pa").alias("i"), part("pb", 2).alias("j"), "id", "x", F.lit(False).alias("left"), "own")

        def meet(rows: pd.DataFrame) -> pd.DataFrame:
            left = rows["left"].to_numpy()
            if left.all() or not left.any():
                return pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64")})
            x, ids, own = np.array(rows["x"].to_list(), dtype=float), rows["id"].to_numpy(), rows["own"].to_numpy()
            # along the distance to one point, a row's partners lie in a window of two radii
            d = _distances(x, x[np.flatnonzero(left)[:1]])[:, 0]
            slack = 1e-6 * (1.0 + radius + d.max())
            order = np.argsort(d, kind="stable")
            a, b = order[left[order]], order[~left[order]]
            src, dst = [], []
            for k in range(0, len(a), 256):
                block = a[k : k + 256]
                lo, hi = np.searchsorted(d[b], [d[block[0]] - radius - slack, d[block[-1]] + radius + slack])
                window = b[lo:hi]
                s, t = np.nonzero(_distances(x[block], x[window]) <= radius + slack)
                s, t = block[s], window[t]
                fit = ~own[t] | (ids[s] < ids[t])
                s, t = s[fit], t[fit]
                good = np.sqrt(((x[s] - x[t]) ** 2).sum(1)) <= radius
                src.append(ids[s[good]])
                dst.append(ids[t[good]])
            return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst)})

        return a.unionByName(b).groupBy("cell", "i", "j").applyInPandas(meet, "src long, dst long")
