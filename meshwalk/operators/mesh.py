"""Runs on the nodes of a graph: walkers go to uniform neighbours, with Hastings weights, block by block."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.rng import uniform_array
from meshwalk.functions.shared import Scratch
from meshwalk.operators import runs
from meshwalk.operators.near import BLOCK_POINTS, Block, Near
from meshwalk.operators.ordered import Ordered, few

#: Edges that one packed block holds about, neighbours of one node that one block holds at most, walkers moved in one task.
EDGES, HUB, WALKERS = 200_000, 50_000, 100_000
PLACE = "struct<node:long,block:int,degree:long>"
#: Walkers that one task moves over the neighbours within a radius.
NEAR_WALKERS = 20_000


def _values(nodes: DataFrame, objective: Callable, ignore_error: bool) -> DataFrame:
    """(id, fx) of nodes (id, x)."""

    def values(batches):
        for b in batches:
            x = np.stack(b["x"].to_numpy()).astype(float) if len(b) else np.empty((0, 1))
            yield pd.DataFrame({"id": b["id"], "fx": runs.evaluate_batch(objective, x, -np.inf, np.inf, None, ignore_error) if len(b) else np.empty(0)})

    return nodes.select("id", "x").mapInPandas(values, "id long, fx double").withColumn("fx", F.coalesce("fx", F.lit(float("nan"))))


class Mesh:
    """Nodes (id, x) with symmetric edges (src, dst); a node's value is the objective's at its x, evaluated once.

    Adjacency is packed by blocks of nodes that follow one another in the order of their ids: for every neighbour its number,
    value, degree and block. A walker is moved by the task that has its node's block for as many steps as it stays there,
    then goes to the block it has stepped into, until it has made all its steps: neighbouring nodes should have near ids, as
    grids do. A node with more than ``hub`` neighbours stands in several packed rows; a walker on it is sent to the one
    that holds the neighbour it draws next. A block with very many walkers is dealt to several tasks. Random numbers are
    functions of seed, walker and step, so the way through blocks changes nothing.

    Walkers start at nodes: points are (walker, x) or (group, x) with the node's id as x. Nodes without neighbours hold
    their walkers. Edges from a node to itself and repeated edges are left out; an edge whose end is no node raises.
    """

    place, block_type = PLACE, "int"

    def __init__(self, nodes: DataFrame, edges: DataFrame, objective: Callable, ignore_error: bool = False, edges_per_block: int | None = None, hub: int | None = None, walkers: int | None = None):
        self.hub, self.walkers, self.objective, self.tables = hub or HUB, walkers or WALKERS, objective, Scratch(nodes.sparkSession)
        cut = self.tables.cut

        fx = _values(nodes, objective, ignore_error)
        e = edges.where("src != dst").select("src", "dst").distinct()
        e = Ordered(e, ["src"], ["dst"], edges_per_block or EDGES).running_sum(F.lit(1).cast("long"), "slot")
        e = cut(e.ranged.select("src", "dst", (F.col("slot") - 1).alias("slot"), F.col("slot_all").alias("degree"), F.col("__range").alias("block")), "edges")
        home = e.groupBy(F.col("src").alias("id")).agg(F.min("block").alias("block"), F.first("degree").alias("degree"))
        n = fx.join(home, "id", "left").select("id", "fx", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))
        self.nodes = cut(n, "nodes")
        node = lambda p: few(self.nodes.select(F.col("id").alias(p), F.col("fx").alias(f"{p}_fx"), F.col("block").alias(f"{p}_block"), F.col("degree").alias(f"{p}_degree")))
        # a node's edges go to its own block, also those of them that the next range holds
        e = e.drop("block").join(few(self.nodes.select(F.col("id").alias("src"), "block")), "src").join(node("dst"), "dst", "left")
        known = F.when(F.col("dst_fx").isNull(), F.raise_error(F.lit("an edge ends at no node"))).otherwise(F.col("dst_fx"))
        sub = F.when(F.col("degree") > self.hub, F.floor(F.col("slot") / self.hub)).otherwise(F.lit(0)).cast("int")
        e = e.select("block", sub.alias("sub"), F.struct("src", "slot", "dst", known.alias("fx"), F.col("dst_degree").alias("degree"), F.col("dst_block").alias("block")).alias("e"))
        packed = e.groupBy("block", "sub").agg(F.sort_array(F.collect_list("e")).alias("e"))  # about edges_per_block + hub edges
        self.packed = cut(packed.select("block", "sub", *[F.col(f"e.{c}").alias(f"e_{c}") for c in ("src", "slot", "dst", "fx", "degree", "block")]), "packed")
        self._facts = {"mesh": runs.table_sum(self.nodes.select("id", "degree")) + " " + runs.table_sum(edges.select("src", "dst").distinct()), "objective": runs.table_sum(self.nodes.select("id", "fx"))}

    def facts(self) -> dict[str, str]:
        return self._facts

    def start(self, points: DataFrame, beta: float, seed: int) -> DataFrame:
        """Walkers at their nodes; raises for one that stands at no node."""
        p = points.select("walker", F.col("x").cast("long").alias("node")).join(few(self.nodes), F.col("node") == F.col("id"), "left")
        block = F.when(F.col("id").isNull(), F.raise_error(F.lit("a walker starts at no node of the mesh"))).otherwise(F.col("block"))
        x = F.struct("node", block.cast(self.block_type).alias("block"), "degree")
        return p.select("walker", F.lit(0).cast("long").alias("t_index"), F.lit(float(beta)).alias("beta"), x.alias("x"), "fx", F.lit(0.0).alias("lw"), F.col("walker").alias("ancestor"), F.col("fx").alias("best_fx"), x.alias("best_x"))

    def neighbours(self, seed: int) -> Callable:
        """A function of a block's packed rows that gives a function of walkers' nodes, numbers, steps and degrees: value, and
        node, degree and block, of the neighbour that each draws."""

        def near(adj):
            src, slot, dst, e_fx, e_degree, e_block = (np.asarray(adj[f"e_{c}"].iloc[0]) for c in ("src", "slot", "dst", "fx", "degree", "block"))
            nodes, begin = np.unique(src, return_index=True)

            def draw(node, w, s, degree):
                at = begin[np.searchsorted(nodes, node)]
                at = at + np.floor(uniform_array(seed, w, s, 21) * degree).astype(np.int64) - slot[at]
                return e_fx[at].astype(float), {"node": dst[at], "degree": e_degree[at], "block": e_block[at]}

            return draw

        return near

    def sweep(self, walkers: DataFrame, seed: int, steps: range) -> DataFrame:
        """``steps`` moves of every walker at its own beta."""
        hub, last = self.hub, steps[-1] if len(steps) else -1
        flat = "walker long, t_index long, beta double, fx double, lw double, ancestor long, best_fx double, node long, block int, degree long, best_node long, best_block int, best_degree long, step long, trial_node long, trial_block int, trial_degree long, trial_fx double, accepted boolean, naccepted long, sub int"
        flat = flat.replace("block int", f"block {self.block_type}")
        names = [c.split(" ")[0] for c in flat.split(", ")]

        def next_sub(w, step, degree):
            """The part of a hub's neighbours that holds the one drawn at the next step."""
            slot = np.floor(uniform_array(seed, w, step + 1, 21) * degree).astype(np.int64)
            return np.where(degree > hub, slot // hub, 0).astype(np.int32)

        def first(batches):
            for b in batches:
                yield b.assign(sub=next_sub(b["walker"].to_numpy(), b["step"].to_numpy(), b["degree"].to_numpy()))[names]

        near = self.neighbours(seed)

        def move(key, b, adj):
            block, sub, draw = key[0], key[1], near(adj)
            c = {n: b[n].to_numpy().copy() for n in names}
            c["fx"], c["trial_fx"], c["best_fx"] = (c[n].astype(float) for n in ("fx", "trial_fx", "best_fx"))  # NaN comes as null
            here = np.arange(len(b))
            while len(here):
                w, s, beta, degree, fx = c["walker"][here], c["step"][here] + 1, c["beta"][here], c["degree"][here], c["fx"][here]
                fy, to = draw(c["node"][here], w, s, degree)
                with np.errstate(over="ignore", invalid="ignore"):
                    p = np.exp(-beta * (fy - np.where(np.isnan(fx), np.inf, fx))) * (degree / to["degree"])
                ok = np.isfinite(fy) & ((p >= 1) | (uniform_array(seed, w, s, 22) < p))
                c["step"][here], c["accepted"][here], c["trial_fx"][here] = s, ok, fy
                for n, v in to.items():
                    c[f"trial_{n}"][here] = v
                    c[n][here[ok]] = v[ok]
                c["fx"][here[ok]] = fy[ok]
                c["naccepted"][here] += ok
                better = here[ok & ~(fy >= c["best_fx"][here])]
                c["best_fx"][better] = c["fx"][better]
                for n in ("node", "degree", "block"):
                    c[f"best_{n}"][better] = c[n][better]
                c["sub"][here] = next_sub(c["walker"][here], c["step"][here], c["degree"][here])
                here = here[(c["block"][here] == block) & (c["sub"][here] == sub) & (c["step"][here] < last)]
            return pd.DataFrame(c)

        begin = F.lit(steps[0] - 1 if len(steps) else -1).cast("long")
        w = walkers.select("walker", "t_index", "beta", "fx", "lw", "ancestor", "best_fx", "x.node", "x.block", "x.degree", *[F.col(f"best_x.{n}").alias(f"best_{n}") for n in ("node", "block", "degree")], begin.alias("step"),
                           *[F.col(f"x.{n}").alias(f"trial_{n}") for n in ("node", "block", "degree")], F.col("fx").alias("trial_fx"), F.lit(False).alias("accepted"), F.lit(0).cast("long").alias("naccepted"))
        key = [F.col(c).alias(f"k_{c}") for c in ("block", "sub")]
        w, done, k = self.tables.cut(w.mapInPandas(first, flat), "walkers"), [], 0
        moving = (F.col("step") < last) & (F.col("degree") > 0)
        while True:
            done.append(w.where(~moving))
            active = w.where(moving)
            crowd = few(active.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / self.walkers).cast("int").alias("parts")))
            a = active.join(crowd, (F.col("block") == F.col("k_block")) & (F.col("sub") == F.col("k_sub"))).withColumn("part", F.pmod(F.xxhash64("walker"), F.col("parts")).cast("int"))
            other = crowd.select(F.col("k_block").alias("j_block"), F.col("k_sub").alias("j_sub"), F.col("parts").alias("j_parts"))
            adj = self.packed.join(other, (F.col("block") == F.col("j_block")) & (F.col("sub") == F.col("j_sub"))).withColumn("j_part", F.explode(F.sequence(F.lit(0), F.col("j_parts") - 1)))
            if active.isEmpty():
                break
            moved = a.groupBy("k_block", "k_sub", "part").cogroup(adj.groupBy("j_block", "j_sub", "j_part")).applyInPandas(move, flat)
            w, k = self.tables.cut(moved, f"walkers{k}"), k + 1
        out = reduce(DataFrame.unionByName, done)
        place = lambda p: F.struct(F.col(f"{p}node").alias("node"), F.col(f"{p}block").alias("block"), F.col(f"{p}degree").alias("degree")).alias(f"{p}x")
        # those that could not move have made their steps all the same
        out = out.withColumn("step", F.lit(last).cast("long"))
        nan: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
        return out.select("walker", "t_index", "beta", place(""), nan("fx"), "lw", "ancestor", nan("best_fx"), place("best_"), "step", place("trial_"), nan("trial_fx"), "accepted", "naccepted")


class NearMesh(Mesh):
    """The mesh of all neighbours within ``radius`` of nodes (id, x), in up to three dimensions, without its edges: a walker draws
    points of the cells around its node until one is near, which makes each neighbour equally likely (:class:`Block`).

    Only degrees are stored. A block is a cube of cells with those around it, of at most ``block_points`` points unless one
    cell's surroundings have more; its walkers are dealt to tasks of about ``walkers``, and the way through blocks changes
    nothing. Nodes with a null or non-finite coordinate have no neighbours.
    """

    place, block_type = "struct<node:long,block:long,degree:long>", "long"

    def __init__(self, nodes: DataFrame, radius: float, dim: int, objective: Callable, unit: list[float] | None = None, ignore_error: bool = False, block_points: int = BLOCK_POINTS, walkers: int = NEAR_WALKERS):
        self.hub, self.walkers, self.objective, self.tables = 1 << 62, walkers, objective, Scratch(nodes.sparkSession)
        self.radius, self.dim = float(radius), dim
        near = Near(nodes, radius, dim, unit, block_points=block_points)
        n = _values(nodes, objective, ignore_error).join(near.degrees(), "id", "left")
        self.nodes = self.tables.cut(n.select("id", "fx", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
        halo = near.halo.drop("block").withColumnRenamed("in_block", "in").join(few(self.nodes), "id")
        halo = halo.withColumnRenamed("block", "home").withColumnRenamed("in", "block").withColumn("sub", F.lit(0))
        self.packed = self.tables.cut(halo, "packed")
        self._facts = {"mesh": f"{self.radius!r} {dim} {unit} " + runs.table_sum(nodes.select("id", "x")), "objective": runs.table_sum(self.nodes.select("id", "fx"))}

    def neighbours(self, seed: int) -> Callable:
        dim, radius = self.dim, self.radius

        def near(points):
            block = Block(points, dim, radius)
            fx, degree, home = block.rows["fx"].to_numpy(float), block.rows["degree"].to_numpy(), block.rows["home"].to_numpy()

            def draw(node, w, s, _):
                at = block.draw(block.index(node), seed, w, s)
                return fx[at], {"node": block.id[at], "degree": degree[at], "block": home[at]}

            return draw

        return near


def anneal_mesh(points: DataFrame, mesh: Mesh, betas: list[float], nsteps: list[int], seed: int, folder: str, interval: int = 1, fixed: bool = True) -> DataFrame:
    """:func:`meshwalk.operators.runs.anneal` on a mesh: points are (walker, x = node), x.node tells where a walker is."""
    return runs.anneal_in(mesh, points, betas, nsteps, seed, folder, interval, fixed)


def exchange_mesh(points: DataFrame, mesh: Mesh, betas: list[float], rounds: int, every: int, seed: int, folder: str) -> DataFrame:
    """:func:`meshwalk.operators.runs.replica_exchange` on a mesh: points are (group, x = node)."""
    return runs.exchange_in(mesh, points, betas, rounds, every, seed, folder)
