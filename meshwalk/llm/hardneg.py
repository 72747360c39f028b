"""Hard negatives by an inverted multi-index: two half-space codebooks form cells, visited by bounds until all is certified."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch
from meshwalk.llm.common import table

SAMPLE = 10_000  # rows that the codebooks are fitted on; all rows are indexed and searched
CELL_ROWS = 256  # rows a cell holds about, as long as MOST_CODES allows
MOST_CODES = 256  # centroids of a half at most: at most 65,536 cells stand in the directory
BLOCK = 512  # rows of a cell that stand in one row of the index; fuller cells have several
STRIPE = 16  # blocks of a cell that meet their visitors under one key
VISITORS = 256  # anchors that a block is multiplied with at a time
FIRST = 4096  # rows that an anchor's first round looks at; each further round looks at 8 times as many
EXACT = 2.0**52  # products up to this are exact in doubles; larger ones are computed in whole numbers of any size
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score between which a negative's lies


def usable_rows(rows: DataFrame) -> DataFrame:
    """(id, label, v): rows whose id, label and vector are there and whose components are all finite; labels changed where
    the id is divisible by 7; v = floor(256 x) as doubles. Of rows that share an id the smallest (label, vector) stands."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    d = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    d = d.where("id is not null and label is not null and x is not null").where(whole)
    d = d.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    v = F.transform("x", lambda c: F.when(F.abs(c * 256.0) < 2.0**53, F.floor(c * 256.0).cast("double")).otherwise(c * 256.0))
    d = d.select("id", "label", v.alias("v"))
    return d.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def fit_codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means of the rows of x by a fixed choice of starts and a fixed number of rounds."""
    rng = np.random.default_rng(13)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None] - 2 * x @ c.T, axis=1)


def padded(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are continued by zeros."""
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


class Index:
    """What every task needs to order cells for a query: the codebooks, and of each cell its rows and its own radii."""

    def __init__(self, books: list[np.ndarray], half: int):
        self.books, self.half = books, half
        self.rows = self.radii = self.most = None

    def halves(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, : self.half], x[:, self.half :]]

    def fill(self, directory: list) -> None:
        """From (cell, rows, r1, r2) of every cell with rows."""
        k = [len(b) for b in self.books]
        self.rows, self.radii = np.zeros(k[0] * k[1], np.int64), np.zeros((2, k[0] * k[1]))
        for cell, n, r1, r2 in directory:
            self.rows[cell], self.radii[0, cell], self.radii[1, cell] = n, r1, r2
        # a centroid's radius: that of the widest of its cells
        grid = self.radii.reshape(2, k[0], k[1])
        self.most = [grid[0].max(axis=1), grid[1].max(axis=0)]

    def visits(self, q: np.ndarray, done: int, rows: int, least: float, highest: float) -> tuple[list[int], int, bool]:
        """The next cells for a query, the number of cells taken from the heap so far, and whether all is certified: no cell
        that is left can hold a score of ``least`` or more.

        Cells come from the heap in the order of the two halves' bounds: product with the centroid plus the query half's
        length times the centroid's radius. Of them, those are visited whose own radii allow a score from ``least`` to
        ``highest``. Stops when the cells visited hold ``rows`` rows.
        """
        k2 = len(self.books[1])
        dots = [b @ h[0] for b, h in zip(self.books, self.halves(q[None]), strict=True)]
        size = [float(np.linalg.norm(h)) for h in self.halves(q[None])]
        slack = 1e-9 * (size[0] + size[1]) * (1 + float(max(np.abs(b).max(initial=0) for b in self.books))) + 0.5  # of rounding
        bound = [d + s * r for d, s, r in zip(dots, size, self.most, strict=True)]
        order = [np.argsort(-b, kind="stable") for b in bound]
        bound = [b[o] for b, o in zip(bound, order, strict=True)]
        heap, out, taken, seen = [(-(bound[0][0] + bound[1][0]), 0, 0)], [], 0, 0
        while heap:
            top, i, j = heap[0]
            if -top + slack < least:
                return out, taken, True
            if seen >= rows:
                return out, taken, False
            heapq.heappop(heap)
            # a cell is entered from its left neighbour, those of the first column from above: each once
            if j + 1 < len(bound[1]):
                heapq.heappush(heap, (-(bound[0][i] + bound[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(bound[0]):
                heapq.heappush(heap, (-(bound[0][i + 1] + bound[1][0]), i + 1, 0))
            taken += 1
            if taken <= done:
                continue
            a, b = int(order[0][i]), int(order[1][j])
            cell = a * k2 + b
            if not self.rows[cell]:
                continue
            mid, reach = dots[0][a] + dots[1][b], size[0] * self.radii[0, cell] + size[1] * self.radii[1, cell]
            if mid + reach + slack >= least and mid - reach - slack <= highest:
                out.append(cell)
                seen += int(self.rows[cell])
        return out, taken, True


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of both; exact whatever their size."""
    far = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(v, axis=1).max(initial=0)
    if far < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    return whole(q) @ whole(v).T


def build_index(d: DataFrame, tables: Scratch, sample: int = SAMPLE) -> tuple[Index, int] | None:
    """Codebooks from a bounded sample, every row in its cell, cells in blocks of bounded size (tables "rows", "blocks")."""
    spark = d.sparkSession
    n, dim = d.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    dim = max(dim, 2)
    half = dim // 2
    some = d.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    x = padded(some.column("v").combine_chunks(), dim)
    k = min(MOST_CODES, max(2, round(math.sqrt(n / CELL_ROWS))))
    index = Index([fit_codebook(x[:, :half], k), fit_codebook(x[:, half:], k)], half)
    books = index.books

    def place(batches):
        for b in batches:
            v = padded(b.column("v"), dim)
            parts = [v[:, :half], v[:, half:]]
            near = [nearest(p, c) for p, c in zip(parts, books, strict=True)]
            r = [np.linalg.norm(p - c[m], axis=1) for p, c, m in zip(parts, books, near, strict=True)]
            raw = np.ascontiguousarray(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array((near[0] * len(books[1]) + near[1]).astype(np.int32)), pa.array(r[0]), pa.array(r[1]), pa.array([row.tobytes() for row in raw], pa.binary())],
                ["id", "label", "cell", "r1", "r2", "v"])

    rows = tables.cut(d.select("id", "label", "v").mapInArrow(place, "id long, label long, cell int, r1 double, r2 double, v binary"), "rows")
    directory = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()  # at most MOST_CODES ** 2 rows
    index.fill(directory)
    parts = F.broadcast(spark.createDataFrame([(int(c), max(1, math.ceil(m / BLOCK))) for c, m, _, _ in directory], "cell int, parts int"))  # as many
    placed = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = placed.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    blocks = blocks.withColumn("stripe", F.floor(F.col("part") / STRIPE).cast("int"))
    tables.cut(blocks.select("cell", "stripe", "rows.id", "rows.label", "rows.v"), "blocks")
    return index, dim


def _search(anchors: DataFrame, index: Index, dim: int, tables: Scratch, keep: int, name: str) -> DataFrame:
    """(anchor, slot, id, score): for every anchor (id, label, v, wins array<struct<slot, lo, hi>>) and slot the ``keep`` best
    rows from lo to hi, of the same label where the slot is -1, else of different labels; ties go to the smaller id.

    Round by round, anchors take their next cells from the heap, blocks meet their visitors in bounded groups and give the
    best of each pair, and the anchors' lists are merged. An anchor is done when no cell left can change one of its lists.
    """
    spark = anchors.sparkSession
    found = "anchor long, slot int, id long, score long"
    blocks = spark.read.schema("cell int, stripe int, id array<long>, label array<long>, v array<binary>").parquet(tables.paths["blocks"])
    # at most MOST_CODES ** 2 rows
    stripes = F.broadcast(spark.createDataFrame([(int(c), math.ceil(math.ceil(int(index.rows[c]) / BLOCK) / STRIPE)) for c in np.flatnonzero(index.rows)], "cell int, stripes int"))
    state = anchors.select(F.col("id").alias("anchor"), "label", "v", "wins", F.lit(0).cast("long").alias("done"), F.transform("wins", lambda w: w["lo"]).alias("least"))
    state = tables.cut(state, f"{name}state")
    best, rows = spark.createDataFrame([], found), FIRST

    def order(budget):
        def run(batches):
            for b in batches:
                out = []
                for r in b.to_pylist():
                    if r["wins"]:
                        q = np.frombuffer(r["v"])
                        cells, done, sure = index.visits(q, r["done"], budget, float(min(r["least"])), float(max(w["hi"] for w in r["wins"])))
                        out.append({"anchor": r["anchor"], "cells": cells, "done": done, "sure": sure})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("anchor", pa.int64()), ("cells", pa.list_(pa.int32())), ("done", pa.int64()), ("sure", pa.bool_())]))

        return run

    def score(batches):
        for b in batches:
            out = [[], [], [], []]
            for r in b.to_pylist():
                ids, labels = np.array(r["id"], np.int64), np.array(r["label"], np.int64)
                v = np.frombuffer(b"".join(r["v"])).reshape(len(ids), dim)
                q = np.frombuffer(b"".join(a["v"] for a in r["visitors"])).reshape(-1, dim)
                s = products(q, v)
                for a, own in zip(r["visitors"], s, strict=True):
                    same, other = (labels == a["label"]) & (ids != a["anchor"]), labels != a["label"]
                    for w, least in zip(a["wins"], a["least"], strict=True):
                        hit = np.flatnonzero((same if w["slot"] < 0 else other) & (own >= max(least, w["lo"])) & (own <= w["hi"]))
                        if len(hit) > keep:
                            hit = hit[np.lexsort((ids[hit], -own[hit]))[:keep]]
                        for o, x in zip(out, ([a["anchor"]] * len(hit), [w["slot"]] * len(hit), ids[hit].tolist(), own[hit].tolist()), strict=True):
                            o.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["anchor", "slot", "id", "score"])

    top = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    while True:
        visits = tables.cut(state.select("anchor", "v", "wins", "done", "least").mapInArrow(order(rows), "anchor long, cells array<int>, done long, sure boolean"), f"{name}visits")
        go = visits.select("anchor", F.explode("cells").alias("cell"))
        crowd = F.broadcast(go.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("groups")))  # one row a cell: as many
        go = go.join(crowd, "cell").withColumn("group", F.pmod(F.xxhash64("anchor"), F.col("groups"))).drop("groups")
        go = go.join(state.select("anchor", "label", "v", "wins", "least"), "anchor")
        go = go.groupBy("cell", "group").agg(F.collect_list(F.struct("anchor", "label", "v", "wins", "least")).alias("visitors"))
        go = go.join(stripes, "cell").select("cell", "visitors", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
        met = blocks.join(go, ["cell", "stripe"]).select("id", "label", "v", "visitors")
        best = best.unionByName(met.mapInArrow(score, found)).withColumn("k", F.row_number().over(top)).where(F.col("k") <= keep).drop("k")
        best = tables.cut(best, f"{name}best")
        # lists that are full need nothing below their last score
        full = best.groupBy("anchor", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") == keep)
        full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "last"))).alias("last"))
        state = state.join(visits.where("not sure").select("anchor", F.col("done").alias("now")), "anchor").join(full, "anchor", "left")
        least = F.transform("wins", lambda w: F.coalesce(F.col("last")[w["slot"]], w["lo"]))
        state = tables.cut(state.select("anchor", "label", "v", "wins", F.col("now").alias("done"), least.alias("least")), f"{name}state")
        if state.isEmpty():
            return best
        rows *= 8


def hard_negatives(rows: DataFrame, anchors=None, sample: int = SAMPLE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and each of its first
    ``POSITIVES`` rows of the same label: the first ``NEGATIVES`` rows of other labels whose score is from 30 to 90 % of the
    positive's. ``anchors`` is a condition on ``id``; rows with ids divisible by 100 by default.

    ``rows`` are (vec_id, embedding, label). Each vector is cut in two halves with a codebook each, fitted to at most
    ``sample`` rows chosen by a hash of the id; every row lies in the cell of its two nearest centroids. A query's cells come
    from a heap by the sum of its halves' bounds (centroid product plus length times radius) until the bound is below the
    last score that its lists need: the results are those of a search through all rows. Scores are exact whole numbers.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Rows that share an id
    count as one, the smallest (label, vector). Vectors of different lengths are continued by zeros, so an empty vector has
    score 0 with all. Equal vectors under different ids are rows of their own; ties go by id. A window of a negative score
    is empty, that of score 0 holds scores of 0. No anchors or an empty table give an empty result; other columns are
    ignored. A score beyond 64 bits raises.
    """
    spark, tables = rows.sparkSession, Scratch(rows.sparkSession)
    d = tables.cut(usable_rows(rows), "usable")
    made = build_index(d, tables)
    none = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if made is None:
        tables.drop_all()
        return none
    index, dim = made
    tables.drop("usable")
    rows = spark.read.schema("id long, label long, cell int, r1 double, r2 double, v binary").parquet(tables.paths["rows"])
    a = rows.where(F.col("id") % 100 == 0 if anchors is None else anchors).select("id", "label", "v")
    a = tables.cut(a, "anchors")
    tables.drop("rows")
    far = 2**62
    every = F.array(F.struct(F.lit(-1).alias("slot"), F.lit(-far).cast("long").alias("lo"), F.lit(far).cast("long").alias("hi")))
    near = _search(a.withColumn("wins", every), index, dim, tables, POSITIVES, "near")
    k = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = tables.cut(near.select("anchor", (F.row_number().over(k) - 1).alias("slot"), "id", "score"), "positives")
    lo, hi = F.ceil(F.col("score") * F.lit(LOW).cast("decimal(20,0)") / 100), F.floor(F.col("score") * F.lit(HIGH).cast("decimal(20,0)") / 100)
    wins = near.select("anchor", F.struct("slot", lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).alias("w")).where("w.lo <= w.hi")
    wins = wins.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("wins"))  # at most POSITIVES
    far_ones = _search(a.join(wins, a["id"] == wins["anchor"]).drop("anchor"), index, dim, tables, NEGATIVES, "far")
    tables.drop_all("positives", "farbest")
    k = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    out = far_ones.select("anchor", "slot", F.row_number().over(k).alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(near.select("anchor", "slot", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP13_SQL = """WITH r AS (SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
 list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT a.id AS anchor, b.id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS s FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
g AS (SELECT anchor, id, s FROM p WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, id) <= 5)
SELECT g.anchor AS anchor_id, g.id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, p.id AS negative_id, g.s AS positive_score, p.s AS negative_score
FROM g JOIN p ON p.anchor = g.anchor AND NOT p.same AND 30 * g.s <= 100 * p.s AND 100 * p.s <= 90 * g.s
WINDOW w AS (PARTITION BY g.anchor, g.id ORDER BY p.s DESC, p.id) QUALIFY row_number() OVER w <= 10"""
