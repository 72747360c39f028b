"""Benchmark decontamination: MinHash containment search parted by the items' sizes, then exact shingle containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut
from meshwalk.llm.common import BROADCAST_ROWS, grams, keep_or_drop, lower_ascii, maybe_broadcast, table, words

SHINGLE = 5
PERCENT = 75


def _with_shingles(df: DataFrame, of) -> DataFrame:
    """Adds ``s``: the distinct 5-word shingles of ``text`` (fewer words: all as one; none: null), each made by ``of``."""
    d = df.withColumn("w", words(lower_ascii(F.col("text"))))
    w = F.col("w")
    few = F.when(F.size(w) > 0, F.array(of([F.array_join(w, " ")])))
    return d.withColumn("s", F.array_distinct(F.coalesce(grams(w, SHINGLE, of), few))).drop("w")


def _hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, token): the hashes of all shingles of each text, repeated ones too."""
    d = docs.withColumn("w", words(lower_ascii(F.col("text"))))
    few = F.when(F.size("w") > 0, F.array(_hash([F.array_join("w", " ")])))
    return d.select("doc_id", F.explode(F.coalesce(grams(F.col("w"), SHINGLE, _hash), few)).alias("token"))


def _hash(ws: list[Column]) -> Column:
    return F.xxhash64(*ws)


def _join(ws: list[Column]) -> Column:
    return F.concat_ws(" ", *ws)


def item_sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(item_id, text)`` to ``(size_class, item_id, token)``: the bottom-k MinHash values of each item.

    An item of m shingles that a document holds to ``percent`` lacks at most m - ceil(m * percent / 100) of them, so among
    its k = that number + 1 smallest hashes one is always shared: the search misses nothing. size_class (powers of eight)
    parts the search: the larger the items of a class, the more nearly its sketches end at the same hash value, its top.
    """
    d = _with_shingles(items, _hash).where(F.col("s").isNotNull())
    m = F.size("s")
    k = (m - F.ceil(m * percent / F.lit(100)) + 1).cast("int")
    return d.select(F.floor(F.log2(m) / 3).cast("int").alias("size_class"), "item_id", F.explode(F.slice(F.sort_array("s"), F.lit(1), k)).alias("token"))


def _small(df: DataFrame, size, broadcast_rows: int) -> DataFrame:
    """``df`` marked for broadcast if its rows' bytes, summed, stay under 32 for each of ``broadcast_rows``."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= 32 * broadcast_rows else df


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Every (document, item) where the document holds at least ``percent`` of the item's distinct 5-word shingles.

    Returns doc_id, item_id, n_item, n_shared (long), one row a pair. Null or wordless texts and items match nothing;
    null ids are kept as ids; repeated rows (and rows that share an id) give a pair once, with the most shared; empty
    tables give an empty result; other columns are ignored. Item sketches, candidates and item shingles are broadcast
    only if they have at most ``broadcast_rows`` rows of a few numbers, or as many bytes as 32 for each, else joined by
    shuffle.

    The search is parted by the items' sizes: a document's hash goes to the classes of sizes whose top it does not exceed,
    and meets there the sketches of that class alone. One small item, whose only hash may be any, opens its own class to
    all hashes and no other. Candidates are cut to a table, the one pass over all texts; the exact step reads those alone.
    """
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").distinct()
    sketch = item_sketches(items, percent)
    per_class = sketch.groupBy("size_class").agg(F.max("token").alias("top"), F.count(F.lit(1)).alias("n")).collect()  # one row a class, 11 at most
    per_class.sort(key=lambda r: (-r["top"], r["size_class"]))
    if not per_class:
        kinds = dict(docs.dtypes) | dict(items.dtypes)
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, n_item long, n_shared long")
    # classes in the order of their tops: those open to a hash are the first ones
    opened = sum(((F.col("token") <= F.lit(r["top"])).cast("int") for r in per_class), F.lit(0))
    classes = F.array(*[F.lit(r["size_class"]) for r in per_class])
    token = _hashes(docs).where(F.col("token") <= F.lit(per_class[0]["top"])).select("doc_id", "token", F.explode(F.slice(classes, F.lit(1), opened)).alias("size_class"))
    found = token.join(maybe_broadcast(sketch, sum(r["n"] for r in per_class), broadcast_rows), ["size_class", "token"]).select("doc_id", "item_id").distinct()
    found = cut(found, "candidates")
    # exact step: shingles as words, of candidate documents alone
    per_doc = found.groupBy(F.col("doc_id").alias("d")).agg(F.collect_set("item_id").alias("ids"))  # no more than there are items
    per_doc = _small(cut(per_doc, "documents"), F.size("ids") * 8 + 16, broadcast_rows)
    pairs = _with_shingles(docs.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d"))), _join).select("doc_id", "s", F.explode("ids").alias("i"))
    own = _with_shingles(items, _join).where(F.col("s").isNotNull()).select("item_id", F.col("s").alias("item"))
    own = _small(cut(own, "items"), F.aggregate("item", F.lit(16).cast("long"), lambda a, x: a + F.octet_length(x) + 24), broadcast_rows)
    pairs = pairs.join(own, F.col("i").eqNullSafe(F.col("item_id")))
    pairs = pairs.select("doc_id", "item_id", F.size("item").cast("long").alias("n_item"), F.size(F.array_intersect("s", "item")).cast("long").alias("n_shared"))
    return pairs.where(100 * F.col("n_shared") >= percent * F.col("n_item")).groupBy("doc_id", "item_id").agg(
        F.max_by("n_item", "n_shared").alias("n_item"), F.max("n_shared").alias("n_shared"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (all columns) without those that hold an item; the cases are as in :func:`contained_items`."""
    return keep_or_drop(docs, contained_items(docs, items, percent).select("doc_id").distinct(), "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def shingle_sql(source: str, key: str) -> str:
    """DuckDB: (key, s) with the distinct 5-word shingles of ``source`` (key, text)."""
    return rf"""SELECT {key}, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {source})"""


OP7_SQL = f"""
WITH d AS ({shingle_sql("documents", "doc_id")}), i AS ({shingle_sql("benchmark", "item_id")}),
du AS (SELECT doc_id, unnest(s) AS t FROM d), iu AS (SELECT item_id, len(s) AS n, unnest(s) AS t FROM i)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_item, CAST(count(*) AS BIGINT) AS n_shared
FROM du JOIN iu USING (t) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 75 * max(n)
"""
