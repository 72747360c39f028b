"""N-gram Jaccard join with adaptive multi-match prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch, cut, release, scope
from meshwalk.llm import common
from meshwalk.llm.common import table
from meshwalk.llm.hashing import ODD, gram_hashes, mix64, powers, text_slices, word_hashes
from meshwalk.operators.graph import component_stars

SHINGLE = 5
PERCENT = 75
#: Pairs across components that one token may propose; a token with more is expensive, and prefixes grow to do without it.
TOKEN_PAIRS = 1000
#: First prefix: one required match more for each STEP shingles.
STEP = 32
#: Rounds of stars among sets that are expensive nearly throughout, at most, and the share of them that a round must link
#: for the next one; what stars leave is compared in any case.
STARS, STAR_SHARE = 4, 0.05
#: Shingles of all sets to be compared up to which they are broadcast (8 bytes each, a set counts as 8 more); beyond it they
#: are joined by shuffle.
BROADCAST_SHINGLES = 500_000
#: Rows up to which a side is broadcast here, at most some 60 bytes each: the driver holds several such sides at a time.
BROADCAST_ROWS = 100_000
#: Pairs that one task verifies.
TASK_PAIRS = 20_000


def maybe_broadcast(df: DataFrame, hashed: bool = False) -> DataFrame:
    """With ``hashed``, a side that is not broadcast is hashed in tasks, so that the other one, of long rows, is not sorted."""
    rows = df.count()
    return df.hint("shuffle_hash") if hashed and rows > BROADCAST_ROWS else common.maybe_broadcast(df, rows, BROADCAST_ROWS)


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti of ``docs`` by doc_id; ``ids`` (one column, distinct, no nulls) are broadcast only when few. A null
    doc_id is none of them. The keys are plain longs: null-safe ones take the driver three to four times the memory."""
    ids = maybe_broadcast(ids.select(F.col(ids.columns[0]).alias("__id")), hashed=True)
    return docs.join(ids, docs["doc_id"] == ids["__id"], how)


def least_overlap(n, percent):
    """Shingles that a set of n shares at least with any set as similar as ``percent``."""
    return (n * percent + 99) // 100


def first_matches(n):
    return n // STEP + 1


def token_sets(texts: list, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct k-word shingles of each text (A-Z lower-cased; fewer words: one shingle)."""
    _, h, offsets = word_hashes(texts, lower=True)
    g, out = gram_hashes(h, k).view(np.int64), []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out.append(np.unique(g[a : b - k + 1]) if b - a >= k else gram_hashes(h[a:b], b - a).view(np.int64) if b > a else np.empty(0, np.int64))
    return out


def _class(s: np.ndarray) -> int | None:
    """Digest of a whole set: equal sets form a class."""
    return int(mix64(np.array([(s.view(np.uint64) * powers(ODD, len(s))).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0]) if len(s) else None


def _sets(k: int, percent: int, part: str):
    """part: prefix (ids, classes and the longest first prefix) or full (classes and whole sets)."""

    def run(batches):
        for rows, texts in text_slices(batches):
            sets = token_sets(texts, k)
            cls = pa.array([_class(s) for s in sets], pa.int64())
            n = pa.array([len(s) for s in sets], pa.int64())
            if part == "prefix":
                sets = [s[: len(s) - least_overlap(len(s), percent) + len(s) * 100 // (STEP * percent) + 2] for s in sets]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
            toks = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))
            cols, names = [cls, n, toks], ["cls", "n", "toks"]
            if part == "prefix":
                cols, names = [rows.column(0), *cols], ["doc_id", *names]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def size_class(n: Column) -> Column:
    """Classes of sizes a fiftieth apart."""
    return F.floor(F.log(n.cast("double")) * 50).cast("int")


def class_floor(c: Column) -> Column:
    """A size not above the least of class ``c``."""
    return F.greatest(F.floor(F.exp(c / F.lit(50.0))).cast("long"), F.lit(1).cast("long"))


class _Join:
    def __init__(self, docs: DataFrame, percent: int, shingle: int, token_pairs: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.percent, self.shingle, self.token_pairs = percent, shingle, token_pairs
        self.tables = Scratch(docs.sparkSession)
        # the one pass over all texts: classes and first prefixes
        self.first = self.tables.cut(self.docs.mapInArrow(_sets(shingle, percent, "prefix"), "doc_id long, cls long, n long, toks array<long>"), "first")
        self.base = self.tables.cut(self.first.select("doc_id", "n", "cls"), "classes")
        self.reps = self.tables.cut(self.base.where("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep")), "reps")
        self.links: DataFrame | None = None
        self.comp, self.settled, self.turn = None, True, 0

    def overlap(self, a: Column, b: Column) -> Column:
        """Shingles that similar sets of sizes a and b share at least."""
        return F.floor(((a + b) * self.percent + 99 + self.percent) / (100 + self.percent))

    def prefixes(self) -> DataFrame:
        """cls, n and toks (the first prefix), one row a class; rows that share an id and a text may stand twice."""
        reps = self.reps.select(F.col("cls").alias("c"), "rep")
        return self.first.join(maybe_broadcast(reps, hashed=True), (F.col("cls") == F.col("c")) & (F.col("doc_id") == F.col("rep")), "left_semi").select("cls", "n", "toks")

    def sets(self, classes: DataFrame) -> DataFrame:
        """cls, n, toks (the whole set) of one document of each of ``classes``."""
        reps = self.reps.join(maybe_broadcast(classes), "cls", "left_semi")
        d = by_id(self.docs, self.tables.cut(reps.select("rep"), "wanted"), "left_semi")
        # rows that share the id may stand twice
        return d.mapInArrow(_sets(self.shingle, self.percent, "full"), "cls long, n long, toks array<long>").where("cls is not null").dropDuplicates(["cls"])

    def verify(self, pairs: DataFrame) -> int:
        """Adds those of ``pairs`` (a, b) whose sets are similar enough, by exact overlap; their number."""
        pairs = self.tables.cut(pairs.select("a", "b"), "pairs")
        count = pairs.count()
        if not count:
            return 0
        # once, for the counting and the joining of it
        classes = self.tables.cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "paired")
        sets = self.tables.cut(self.sets(classes), "sets")
        small = (sets.agg(F.sum(F.col("n") + 8)).first()[0] or 0) <= BROADCAST_SHINGLES
        one = lambda c: (lambda x: F.broadcast(x) if small else x)(sets.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("toks").alias(f"t{c}")))
        both = F.size(F.array_intersect("ta", "tb"))
        # pairs are few bytes and much work: dealt by number, not by size
        near = pairs.repartition(count // TASK_PAIRS + 1)
        found = near.join(one("a"), "a").join(one("b"), "b").where((100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")) & (100 * both >= self.percent * (F.col("na") + F.col("nb") - both)))
        self.turn += 1
        found = self.tables.cut(found.select("a", "b"), f"links{self.turn}")
        self.links = found if self.links is None else self.links.unionAll(found)
        self.settled = False
        self.tables.drop("pairs", "paired", "wanted", "sets")
        release(self.docs.sparkSession)
        return found.count()

    def components(self) -> DataFrame:
        """cls, comp for the classes that have links, but the one that names its component."""
        if self.links is None:
            return self.reps.limit(0).select("cls", F.col("cls").alias("comp"))
        if not self.settled:
            with scope(self.docs.sparkSession) as folder:
                comp = component_stars(self.links).toDF("cls", "comp")
                path = f"{folder.rpartition('/')[0]}/components-{folder.rpartition('/')[2]}"
                comp.write.parquet(path)
            comp = self.docs.sparkSession.read.schema(comp.schema).parquet(path)
            self.tables.drop("components", *[f"links{k}" for k in range(1, self.turn + 1)])
            self.tables.paths["components"] = path
            self.comp, self.settled = comp, True
            release(self.docs.sparkSession)
            # what is known so far is a star for each component
            self.links = comp.select(F.col("cls").alias("a"), F.col("comp").alias("b"))
        return self.comp

    def with_components(self, rows: DataFrame) -> DataFrame:
        return rows.join(maybe_broadcast(self.components()), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    def star(self, rows: DataFrame, orders: list) -> int:
        """Verify every class against one hub for each order: of the hubs of its tokens (the class that the order puts last)
        in another component, the one it meets most often. Linear in the tokens, however many classes share one."""
        t = self.with_components(rows)
        one = F.struct(F.col("cls").alias("hub"), F.col("comp").alias("home"))
        hub = t.groupBy("token").agg(F.array(*[F.max_by(one, F.struct(o, "cls")) for o in orders]).alias("hubs")).select("token", F.posexplode("hubs").alias("order", "h"))
        t = t.join(hub.select("token", "order", "h.*"), "token").where("comp != home")
        t = t.groupBy("cls", "order", "hub", "n").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= F.greatest(F.lit(1), F.floor(F.col("n") * self.percent / (100 * STEP))))
        t = t.groupBy("cls", "order").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
        return self.verify(t.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct())

    def labelled(self, tokens: DataFrame) -> DataFrame:
        """Rows (token, cls, rank, n) that some other component has too, with comp and whether the token is expensive."""
        t = self.with_components(tokens)
        cost = t.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        cost = cost.select("token", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("cost")).where("cost > 0")
        return t.join(cost.select("token", (F.col("cost") > self.token_pairs).alias("heavy")), "token")

    def propose(self, rows: DataFrame) -> DataFrame:
        """Pairs of classes in different components, not both dense, that share at least ``need`` of the given tokens."""
        x, y = (rows.select("token", *[F.col(c).alias(f"{c}{i}") for c in ("cls", "comp", "n", "need", "dense")]) for i in "ab")
        sized = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        p = x.join(y, "token").where((F.col("clsa") < F.col("clsb")) & (F.col("compa") != F.col("compb")) & sized & ~(F.col("densea") & F.col("denseb")))
        p = p.groupBy(F.col("clsa").alias("a"), F.col("clsb").alias("b")).agg(F.count(F.lit(1)).alias("m"), F.least(F.first("needa"), F.first("needb")).alias("need"))
        return p.where("m >= need")

    def cheapest_first(self, full: DataFrame) -> DataFrame:
        """Rows (token, cls, comp, n, rank) of the plain prefixes of ``full`` sets (token, cls, n) when tokens are ordered by
        the pairs across components that they propose: those of one component only come first and need not be returned."""
        t = self.with_components(full)
        cost = t.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        cost = cost.select("token", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("cost"))
        own = t.join(cost, "token").groupBy("cls", "comp", "n").agg(F.sort_array(F.collect_list(F.struct("cost", "token"))).alias("own"))
        own = own.withColumn("own", F.slice("own", F.lit(1), (F.col("n") - F.floor((F.col("n") * self.percent + 99) / 100) + 1).cast("int")))
        return own.select("cls", "comp", "n", F.posexplode("own").alias("rank", "t")).where("t.cost > 0").select("t.token", "cls", "comp", "n", F.col("rank").cast("long").alias("rank"))

    def propose_sized(self, rows: DataFrame) -> DataFrame:
        """Pairs of classes in different components that share a token of the prefixes which their two sizes ask for.

        Sets of sizes a <= b that are similar share o = overlap(a, b) shingles, so their first a - o + 1 and b - o + 1
        meet. Each set offers the prefix for partners not smaller than itself under its own size class, and looks in
        every size class below with the prefix for that class: the nearer in size, the shorter, so that near copies of
        one size meet at what they changed themselves, not at the text they have in common.
        """
        x = rows.where(F.col("rank") <= F.col("n") - self.overlap(F.col("n"), F.col("n"))).withColumn("sized", size_class(F.col("n")))
        y = rows.withColumn("sized", F.explode(F.sequence(size_class(F.greatest(F.floor(F.col("n") * self.percent / 100), F.lit(1))), size_class(F.col("n")))))
        y = y.where(F.col("rank") <= F.col("n") - self.overlap(class_floor(F.col("sized")), F.col("n")))
        x, y = (d.select("token", "sized", *[F.col(c).alias(f"{c}{i}") for c in ("cls", "comp", "n", "rank")]) for d, i in ((x, "a"), (y, "b")))
        o = self.overlap(F.col("na"), F.col("nb"))
        sized = (100 * F.col("na") >= self.percent * F.col("nb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("clsa") < F.col("clsb"))))
        # rows of a small file become many here, which Spark does not see when it judges whether a side can be broadcast
        p = x.join(y.hint("merge"), ["token", "sized"]).where(sized & (F.col("compa") != F.col("compb")) & (F.col("ranka") <= F.col("na") - o) & (F.col("rankb") <= F.col("nb") - o))
        return p.select(F.least("clsa", "clsb").alias("a"), F.greatest("clsa", "clsb").alias("b")).distinct()

    def run(self) -> None:
        overlap = lambda: F.floor((F.col("n") * self.percent + 99) / 100)
        base, tables = F.col("n") - overlap(), self.tables
        every = self.prefixes().select("cls", "n", F.posexplode("toks").alias("rank", "token"))
        live = every.groupBy("token").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high").select("token", "c")
        live = tables.cut(every.join(live, "token").distinct(), "live")
        tables.drop("first")
        release(self.docs.sparkSession)
        # stars join most groups of near copies before any pairs are made: hubs are first the classes with the most common
        # tokens (a text is more central than its copies), then others at random
        fame = tables.cut(live.groupBy("cls").agg(F.avg(F.log("c")).alias("fame")), "fame")
        self.star(live.join(maybe_broadcast(fame), "cls"), [F.col("fame"), F.xxhash64("cls", F.lit(0))])
        # first prefixes: first_matches(n) tokens must be shared, of which too few may be expensive
        rows = self.labelled(live.select("token", "cls", "rank", "n"))
        rows = tables.cut(rows.withColumn("ell", F.floor(F.col("n") / STEP) + 1), "labelled")
        tables.drop("live")
        dear = F.sum(F.when(F.col("heavy") & (F.col("rank") < base + F.col("ell")), 1).otherwise(0))
        need = rows.groupBy("cls").agg((F.first("ell") - dear).alias("need"))
        need = tables.cut(need, "need")
        cheap = rows.where("not heavy").join(maybe_broadcast(need.select("cls", F.greatest("need", F.lit(1)).alias("need"))), "cls").withColumn("dense", F.lit(False))
        self.verify(self.propose(cheap))
        tables.drop("labelled")
        # longer prefixes, over whole sets, for those with as many expensive tokens as required matches
        longer = need.where("need <= 0").select("cls")
        if longer.isEmpty():
            return
        full = tables.cut(self.sets(longer).select("cls", "n", F.posexplode("toks").alias("rank", "token")), "full")
        rows = tables.cut(self.labelled(full), "labelled2")
        ranks = F.sort_array(F.collect_list(F.when(F.col("heavy"), F.col("rank").cast("long"))))
        n = rows.groupBy("cls").agg(F.first("n").alias("n"), ranks.alias("ranks"))
        # each expensive token inside the prefix asks for one match, and one token, more
        n = n.withColumn("ell", F.aggregate("ranks", F.lit(1).cast("long"), lambda a, r: F.when(r < F.col("n") - overlap() + a, a + 1).otherwise(a)))
        n = tables.cut(n.select("cls", "ell", (F.col("ell") > overlap()).alias("dense")), "longer")
        rows = rows.join(maybe_broadcast(n), "cls").withColumn("need", F.lit(1).cast("long"))
        inside = F.col("dense") | (F.col("rank") < base + F.col("ell"))
        self.verify(self.propose(rows.where(~F.col("heavy") & inside)))
        # sets that are expensive nearly throughout are compared with each other on prefixes of their cheapest tokens
        dense = n.where("dense").select("cls")
        if not dense.isEmpty():
            # here many sets meet at every token: again stars first, at first around the most common texts, as long as a
            # round still joins many
            every = full.join(maybe_broadcast(dense), "cls", "left_semi")
            fame = every.join(every.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "token").groupBy("cls").agg(F.avg(F.log("c")).alias("fame"))
            rows = tables.cut(rows.where(F.col("dense") & (F.col("rank") < base + 1)).select("token", "cls", "n").join(maybe_broadcast(tables.cut(fame, "fame")), "cls"), "stars")
            tables.drop("labelled2")
            sets = dense.count()
            for k in range(STARS):
                if self.star(rows, [F.col("fame"), F.xxhash64("cls", F.lit(2 * k + 1)), F.xxhash64("cls", F.lit(2 * k + 2))]) < STAR_SHARE * sets:
                    break
            left = tables.cut(self.cheapest_first(every.select("token", "cls", "n")), "cheapest")
            self.verify(self.propose_sized(left))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, token_pairs: int = TOKEN_PAIRS) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id: documents joined to components by Jaccard similarity of word shingles.

    The order of tokens is that of their hash. A set of n with required matches l has the prefix of its first
    n - ceil(n * percent / 100) + l tokens; two similar sets share at least l tokens of the prefixes for l. So a set may
    ignore l - 1 tokens of its prefix: those proposing too many pairs (estimated over all documents as pairs across the
    components known so far). Where they are more, the prefix and the required matches grow until they suffice. Copies
    count once (class_id is the smallest doc_id with the same set); links inside one component are not needed and not
    made; every other candidate pair is verified by exact overlap. No cap on candidates: sets whose tokens are
    nearly all expensive are compared with each other on plain prefixes in the order of the tokens' cost.

    Null and wordless texts have n_shingles 0 and are linked with nothing (component_id is their doc_id). Rows with a
    null doc_id get the component of their class if it has an id, else null. Repeated rows get equal results. An empty
    table gives an empty result; other columns are ignored, whatever their names.
    """
    j = _Join(docs, percent, shingle, token_pairs)
    j.run()
    comp = j.reps.join(maybe_broadcast(j.components()), "cls", "left").select("cls", "rep", F.coalesce("comp", "cls").alias("comp"))
    low = comp.groupBy("comp").agg(F.min("rep").alias("component_id"))
    comp = j.tables.cut(comp.join(low, "comp").select(F.col("cls"), F.col("rep").alias("class_id"), "component_id"), "result")
    j.tables.drop_all("classes", "result")
    return j.base.join(maybe_broadcast(comp), "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) with one document of every component, the one with the smallest doc_id; of rows that share it, all."""
    gone = cut(near_duplicates(docs, percent).where("doc_id > component_id").select("doc_id").distinct(), "gone")
    release(docs.sparkSession)
    return by_id(docs, gone, "left_anti")


def op2_jaccard_components(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
