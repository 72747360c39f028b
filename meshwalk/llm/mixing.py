"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut
from meshwalk.llm.common import table

MOST = 3  # copies of a document, and a target's multiple of its source
BLOCK = 256  # units folded one after another; residuals of blocks go up the tree
EPS = 1e-9
SPAN = 4096  # numbers that one row of equal ones is given at a time
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size)`` to ``(source, source_size, target)``: the sources by code point, null last, weigh 1, 2, 3,
    repeating; a target stops at ``MOST`` times its source and the excess is shared again by weight.

    That fixed point is a water level: with sources in the order of cap / weight, those before the first k whose cap
    reaches the level of the rest are full. One row a source; an empty table gives an empty one. Windows over all sources
    run in one task, one small row each: sources are to be names that people keep, at most some millions.
    """
    by_name, all_rows = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double")).withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    fill = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("k", F.row_number().over(order))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(fill), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(fill), F.lit(0.0))))
    level = F.min_by("level", F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("k"))).over(all_rows)
    return s.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"))


def _uniform(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(units: Column, seed: Column) -> Column:
    """Pivot along ``units`` (structs row, size, p): the carried unit and the next trade mass, up or down with the odds
    that keep each one's expectation, until one of them is whole; size-weighted mass is kept exactly."""

    def step(state: Column, u: Column) -> Column:
        c = state["carry"]
        x, y, s, r = c["p"] * c["size"], u["p"] * u["size"], c["size"], u["size"]
        up, down = F.least(s - x, y), F.least(x, r - y)
        rise = _uniform(seed, c["key"], u["key"], F.size(state["done"])) * (up + down) < down
        x2, y2 = F.when(rise, x + up).otherwise(x - down), F.when(rise, y - up).otherwise(y + down)
        p, q = x2 / s, y2 / r
        whole = (p <= EPS) | (p >= 1 - EPS)
        give = lambda a, v: F.struct(a["row"].alias("row"), a["size"].alias("size"), a["key"].alias("key"), v.alias("p"))
        a, b = give(c, F.round(p, 0)), give(c, p)
        d, e = give(u, F.round(q, 0)), give(u, q)
        # if both became whole, the carried one waits as a whole unit and is dealt out by the next step unchanged
        return F.when(
            (c["p"] <= EPS) | (c["p"] >= 1 - EPS),
            F.struct(F.concat(state["done"], F.array(give(c, F.round(c["p"], 0)))).alias("done"), give(u, u["p"]).alias("carry")),
        ).when(
            whole, F.struct(F.concat(state["done"], F.array(a)).alias("done"), e.alias("carry"))
        ).otherwise(F.struct(F.concat(state["done"], F.array(d)).alias("done"), b.alias("carry")))

    first = F.struct(F.slice(units, 1, 0).alias("done"), units[0].alias("carry"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), first, step)


def _spread(units: DataFrame, block: int) -> DataFrame:
    """``units`` with key, and spread: the number of blocks of its group, of about ``block`` units each."""
    n = cut(units.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).alias("spread")), "groups").withColumnRenamed("group", "g")
    return units.join(_small_side(n), F.col("group").eqNullSafe(F.col("g"))).drop("g")


def pivotal_copies(units: DataFrame, seed: int = 7, block: int = BLOCK, room: DataFrame | None = None) -> DataFrame:
    """``units``: group, row (struct), size double, p in (0, 1). Returns group, row and take 0 or 1; in every group
    the sum of size * take differs from that of size * p by less than one unit's size.

    Level by level: a group's units are dealt to its own number of blocks by a hash (a group of any size spreads over many,
    one of a few hundred units is folded at once), each block is folded by itself and passes at most one fractional unit
    up, until the group has one block. Its last unit is rounded by chance, with its probability; where ``room`` (r, down, up)
    tells how much other units can give less or more than their share, it is rounded so that they can make it good.
    """
    level, out, depth = _spread(units.withColumn("key", F.xxhash64(F.lit(seed), F.col("row"))), block), None, 0
    while True:
        b = F.pmod(F.xxhash64(F.lit(depth), F.col("key")), F.col("spread"))
        folded = (
            level.withColumn("b", b).groupBy("group", "b", "spread").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("down"), "key", "size", "row", "p"))).alias("u"))
            .withColumn("u", F.transform("u", lambda x: F.struct(x["row"].alias("row"), x["size"].alias("size"), x["key"].alias("key"), x["p"].alias("p"))))
            .withColumn("f", _fold(F.col("u"), F.lit(seed + depth)))
        )
        # a carried unit of a group's only block is the last one
        folded = cut(folded.select("group", "spread", "f"), "folded")
        done = folded.select("group", F.explode("f.done").alias("x")).select("group", "x.row", F.col("x.p").cast("int").alias("take"))
        last = folded.where("spread = 1").select("group", "f.carry.*")
        last = last.join(_small_side(room), F.col("group").eqNullSafe(F.col("r")), "left") if room is not None else last.withColumns({"down": F.lit(None).cast("double"), "up": F.lit(None).cast("double")})
        rise, fall = F.coalesce(F.col("size") * (1 - F.col("p")) <= F.col("down"), F.lit(False)), F.coalesce(F.col("size") * F.col("p") <= F.col("up"), F.lit(False))
        chance = _uniform(F.lit(seed), F.lit("last"), F.col("key")) < F.col("p")
        whole = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
        near = F.when(F.lit(room is None) | whole | (rise & fall), chance).when(rise, True).when(fall, False).otherwise(F.col("p") >= 0.5)
        last = last.select("group", "row", near.cast("int").alias("take"))
        out = done.unionAll(last) if out is None else out.unionAll(done).unionAll(last)
        level = folded.where("spread > 1").select("group", "f.carry.*", F.ceil(F.col("spread") / block).alias("spread"))
        depth += 1
        if level.isEmpty():
            return out


def _small_side(df: DataFrame) -> DataFrame:
    """One row a group: broadcast if they are few."""
    return F.broadcast(df) if df.count() <= 100_000 else df


def _given(taken: DataFrame, units: DataFrame) -> DataFrame:
    """(g, over): by how much a group's taken sizes exceed what was asked for."""
    got = taken.groupBy("group").agg(F.sum(F.col("take") * F.col("row.words")).alias("got"))
    want = units.groupBy(F.col("group").alias("g")).agg(F.sum(F.col("size") * F.col("p")).alias("want"))
    return cut(want.join(got, F.col("g").eqNullSafe(F.col("group"))).select("g", (F.col("got") - F.col("want")).alias("over")), "over")


def settled_copies(units: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """:func:`pivotal_copies` in two trees: units larger than their group's median first; what their last one, which is
    rounded by chance, gives too much or too little, the others' probabilities make good before they are dealt. So a group's
    sum ends within a unit of about the median size, as long as its smaller units have that much to give."""
    mid = cut(units.groupBy(F.col("group").alias("g")).agg(F.percentile_approx("size", 0.5, 1000).alias("mid")), "medians")
    d = units.join(_small_side(mid), F.col("group").eqNullSafe(F.col("g"))).drop("g")
    large = cut(d.where("size > mid").drop("mid"), "large")
    small = d.where("size <= mid").drop("mid")
    room = small.groupBy(F.col("group").alias("r")).agg(F.sum(F.col("size") * F.col("p")).alias("down"), F.sum(F.col("size") * (1 - F.col("p"))).alias("up"))
    room = cut(room, "room")
    first = pivotal_copies(large, seed, block, room)
    over = cut(_given(first, large).join(room, F.col("g").eqNullSafe(F.col("r"))).drop("r"), "over")
    small = small.join(_small_side(over), F.col("group").eqNullSafe(F.col("g")), "left")
    less = F.col("p") * (1 - F.least(F.lit(1.0), F.try_divide("over", "down")))
    more = F.col("p") + (1 - F.col("p")) * F.least(F.lit(1.0), F.try_divide(-F.col("over"), F.col("up")))
    p = F.when(F.coalesce("over", F.lit(0.0)) == 0, F.col("p")).when(F.col("over") > 0, less).otherwise(more)
    small = cut(small.select("group", "row", "size", p.alias("p")), "small")
    whole = (F.col("p") <= EPS) | (F.col("p") >= 1 - EPS)
    sure = small.where(whole).select("group", "row", F.round("p").cast("int").alias("take"))
    return first.unionAll(pivotal_copies(small.where(~whole), seed + 1000, block)).unionAll(sure)


def mix(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """Copies of every document such that each source's words meet its target.

    Returns one row per input row: doc_id, source, size (words), source_size, target, copies (0 to MOST), taken.
    Documents larger than their source's median are settled first, the others make good what those leave
    (:func:`settled_copies`). A text of any length counts whole; a source whose target one huge document decides can miss it
    by as much as its smaller documents cannot make good.
    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, last;
    repeated rows are dealt with each by itself; null doc_ids are kept; an empty table gives an empty result; other
    columns are ignored. The same input gives the same result, however it is partitioned.
    """
    # the one pass over the texts
    d = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    # copies of a row are told apart by their number; equal rows are interchangeable
    d = cut(d.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times")), "sizes")
    one, several = d.where("times = 1").select("doc_id", "source", "size", F.col("times").alias("nth")), d.where("times > 1")
    # a row repeated very often is numbered in stretches, by several tasks
    several = several.withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / SPAN))))
    several = several.repartition("doc_id", "source", "size", "s") if not several.isEmpty() else several
    several = several.select("doc_id", "source", "size", F.explode(F.sequence(F.col("s") * SPAN + 1, F.least("times", (F.col("s") + 1) * SPAN))).alias("nth"))
    d = one.unionByName(several)
    t = source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")))
    t = t.select(F.col("source").alias("group"), "source_size", "target")
    d = d.join(F.broadcast(t) if t.count() <= 100_000 else t, F.col("source").eqNullSafe(F.col("group")))
    want = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    d = d.withColumn("base", F.floor(want + EPS)).withColumn("p", F.greatest(want - F.col("base"), F.lit(0.0)))
    fractional = F.col("p") > EPS
    row = F.struct("doc_id", "source", "nth", "base", F.col("size").alias("words"), "source_size", "target")
    taken = settled_copies(d.where(fractional).select("group", row.alias("row"), F.col("size").cast("double").alias("size"), "p"), seed, block)
    sure = d.where(~fractional).select("group", row.alias("row"), F.lit(0).alias("take"))
    copies = (F.col("row.base") + F.col("take")).cast("int")
    return taken.unionAll(sure).select(
        "row.doc_id", "row.source", F.col("row.nth").alias("nth"), F.col("row.words").alias("size"), "row.source_size", "row.target",
        copies.alias("copies"), (copies * F.col("row.words")).cast("long").alias("taken"),
    )


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")
