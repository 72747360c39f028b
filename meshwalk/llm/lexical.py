"""Ranked lexical search over a grid of terms and documents, kept as quadtrees of impact maxima (a K2-treap)."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch
from meshwalk.llm.common import table
from meshwalk.llm.hashing import text_slices

#: Fixed values of the score: impact scale, length normalisation in percent.
SCALE, PERCENT, NORM = 1_000_000_000, 100, 90
TOP = 10
DOCS = 2048  # columns of a grid
POSTINGS = 1 << 18  # cells of a grid with something in them, about
UNIT = 1 << 12  # in which bounds above the lowest level are stored, rounded up
ITEMS, ITEM_BYTES = 4096, 16 << 20  # items that are searched for at a time, and the bytes of their texts, about
FIRST_GRIDS = 4  # grids of the highest bounds that every item is looked for first
WIDE = 256  # document ranges that are split at a time

#: Bytes to bytes: separators to a space, A-Z to a-z; all of 0x80 and above are parts of words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ONES = np.array([bin(k).count("1") for k in range(16)], np.uint8)


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(LETTERS).split() if text else []


def item_terms(items: DataFrame, group: int, groups: int) -> list[tuple]:
    """(item_id, its distinct terms) of one group of items; rows that share an item_id are one item."""
    some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group).select("item_id", "text").collect()  # about ITEMS rows, ITEM_BYTES
    own: dict = {}
    for item, text in some:
        own.setdefault(item, set()).update(terms((text or "").encode()))
    return [(k, sorted(own[k])) for k in sorted(own, key=lambda k: (k is not None, k))]


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, t, tf) of every document with a term: its number of terms, and those in the vocabulary with their counts."""

    def run(batches):
        for part, texts in text_slices(batches):
            n, t, tf = [], [], []
            for text in texts:
                own = terms(text)
                n.append(len(own))
                # the vocabulary's words of this text, in order of their numbers
                have = sorted((vocabulary[w], c) for w, c in Counter(own).items() if w in vocabulary)
                t.append(np.array([k for k, _ in have], np.int32).tobytes())
                tf.append(np.array([c for _, c in have], np.int32).tobytes())
            out = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(t, pa.binary()), pa.array(tf, pa.binary())], ["doc_id", "n", "t", "tf"])
            yield out.filter(pa.array([k > 0 for k in n], pa.bool_()))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, t binary, tf binary")


def document_counts(post: DataFrame, size: int) -> np.ndarray:
    """Documents of every vocabulary term: counted in each task, then added up."""

    def run(batches):
        count = np.zeros(size, np.int64)
        for b in batches:
            count += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32), minlength=size)
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(count[k])], ["t", "df"])

    df = np.zeros(size, np.int64)
    for k, n in post.select("t").mapInArrow(run, "t int, df long").groupBy("t").agg(F.sum("df")).collect():  # one row a term
        df[k] = n
    return df


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows: np.ndarray, cols: np.ndarray, value: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Levels from the root down, but for the lowest: of each quarter that is not empty the mask of its quarters and its
    largest value; and the order of the cells. Nodes of a level stand in Morton order, so that children are found by
    counting bits."""
    height = max(1, int(max(rows.max(initial=0), cols.max(initial=0))).bit_length())
    code = (_spread(rows) << np.uint64(1)) | _spread(cols)
    order = np.argsort(code)
    code, top = code[order], value[order]
    masks, tops = [], []
    for _ in range(height):
        parent = code >> np.uint64(2)
        start = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
        masks.append(np.bitwise_or.reduceat((np.uint8(1) << (code & np.uint64(3)).astype(np.uint8)), start))
        top = np.maximum.reduceat(top, start)
        tops.append(top)
        code = parent[start]
    return masks[::-1], tops[::-1], order


class Treap:
    """A grid ready to be searched: masks and maxima (in UNITs) of its levels, values of its cells, which a row's weight
    multiplies. An absent node has number -1, mask 0, maximum and value 0."""

    def __init__(self, masks: list[np.ndarray], tops: list[np.ndarray], cells: np.ndarray):
        self.masks = [np.concatenate([m, np.zeros(1, np.uint8)]) for m in masks]
        self.tops = [np.concatenate([t, np.zeros(1, t.dtype)]) for t in [*tops, cells]]
        self.first = [(np.cumsum(_ONES[m], dtype=np.int64) - _ONES[m]).astype(np.int32) for m in self.masks]
        self.height = len(masks)

    def search(self, rows: np.ndarray, weight: np.ndarray, most: np.ndarray, least: int, ids: np.ndarray, k: int = TOP) -> list[tuple[int, int]]:
        """(score, column) of the ``k`` best columns with a sum over ``rows`` of at least ``least`` and above 0.

        All rows' paths go down together over one range of columns: its bound is the sum of the rows' cells, each at most
        the row's own maximum ``most``; a column's sum takes cells times ``weight``. The ranges with the highest bounds are split first, many at a time; the search ends
        when no range left can reach the k-th best column found. Ties go by ``ids``.
        """
        # of every level: the ranges that wait to be split (first column, the rows' nodes, bound)
        wait: list[list[tuple]] = [[] for _ in range(self.height)]
        wait[0].append((np.zeros(1, np.int64), np.zeros((1, len(rows)), np.int32), np.array([most.sum()])))
        heads = [(-int(most.sum()), 0)]  # the highest bound of a level, by a heap of levels
        scores, columns, least = np.empty(0, np.int64), np.empty(0, np.int64), max(least, 1)
        while heads and -heads[0][0] >= least:
            _, level = heapq.heappop(heads)
            if not wait[level]:
                continue
            cols, nodes, bound = (np.concatenate(x) for x in zip(*wait[level], strict=True))
            ok = bound >= least
            cols, nodes, bound, wait[level] = cols[ok], nodes[ok], bound[ok], []
            if len(cols) > WIDE:
                cut = np.argpartition(-bound, WIDE)
                rest, cut = cut[WIDE:], cut[:WIDE]
                wait[level].append((cols[rest], nodes[rest], bound[rest]))
                heapq.heappush(heads, (-int(bound[rest].max()), level))
                cols, nodes = cols[cut], nodes[cut]
            if not len(cols):
                continue
            down = ((rows >> (self.height - 1 - level)) & 1).astype(np.uint8)
            mask, first = self.masks[level][nodes], self.first[level][nodes]
            for side in (0, 1):
                quarter = 2 * down + np.uint8(side)
                child = np.where((mask >> quarter) & 1, first + _ONES[mask & ((np.uint8(1) << quarter) - np.uint8(1))], -1)
                sums = np.minimum(self.tops[level + 1][child].astype(np.int64) * (UNIT if level + 1 < self.height else weight), most).sum(axis=1)
                ok = sums >= least
                if not ok.any():
                    continue
                c, s = cols[ok] * 2 + side, sums[ok]
                if level + 1 < self.height:
                    wait[level + 1].append((c, child[ok], s))
                    heapq.heappush(heads, (-int(s.max()), level + 1))
                    continue
                scores, columns = np.concatenate([scores, s]), np.concatenate([columns, c])
                if len(scores) > k:
                    best = np.lexsort((ids[columns], -scores))[:k]
                    scores, columns = scores[best], columns[best]
                if len(scores) == k:
                    least = max(least, int(scores.min()))
        return list(zip(scores.tolist(), columns.tolist(), strict=True))


def build_grids(post: DataFrame, weights: np.ndarray, docs: int, length: int) -> DataFrame:
    """(grid, doc_id, t, most, masks, tops, cells): quadtrees over the impacts of ``DOCS`` documents each, or of fewer when they
    have many postings. Rows are terms by falling weight, columns documents by their length, so that cells are even;
    ``t`` and ``most`` are the rows' terms and largest impacts."""

    def grid(number: str, ids: list, n: np.ndarray, t: list, tf: list) -> dict:
        order = np.lexsort((np.arange(len(n)), n))
        count = np.array([len(x) // 4 for x in t])
        col = np.repeat(np.argsort(order), count)
        term, f = np.frombuffer(b"".join(t), np.int32), np.frombuffer(b"".join(tf), np.int32).astype(np.int64)
        m = PERCENT - NORM + (NORM * n * docs) // length
        cell = (SCALE * f) // (1000 * f + 8 * np.repeat(m, count))  # at most SCALE / 1000
        impact = weights[term] * cell
        hit = impact > 0
        term, col, impact, cell = term[hit], col[hit], impact[hit], cell[hit]
        have = np.unique(term)
        have = have[np.lexsort((have, -weights[have]))]
        place = np.zeros(len(weights), np.int64)
        place[have] = np.arange(len(have))
        row = place[term]
        most = np.zeros(len(have), np.int64)
        np.maximum.at(most, row, impact)
        masks, tops, by = build_treap(row, col, -(-impact // UNIT)) if len(row) else ([], [], np.empty(0, int))
        return {"grid": number, "doc_id": [ids[k] for k in order], "t": have.astype(np.int32).tobytes(), "most": most.tobytes(), "masks": [m.tobytes() for m in masks], "tops": [x.astype(np.uint32).tobytes() for x in tops], "cells": cell[by].astype(np.uint32).tobytes()}

    schema = pa.schema([("grid", pa.string()), ("doc_id", pa.list_(pa.int64())), ("t", pa.binary()), ("most", pa.binary()), ("masks", pa.list_(pa.binary())), ("tops", pa.list_(pa.binary())), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        ids, n, t, tf, size, number, task = [], [], [], [], 0, 0, TaskContext.get().partitionId()
        flush = lambda: pa.RecordBatch.from_pylist([grid(f"{task}-{number}", ids, np.array(n, np.int64), t, tf)], schema)
        for b in batches:
            for i, k, x, f in zip(*[c.to_pylist() for c in b.columns], strict=True):
                ids.append(i), n.append(k), t.append(x), tf.append(f)
                size += len(x) // 4
                if len(ids) >= DOCS or size >= POSTINGS:
                    yield flush()
                    ids, n, t, tf, size, number = [], [], [], [], 0, number + 1
        if ids:
            yield flush()

    return post.select("doc_id", "n", "t", "tf").mapInArrow(run, "grid string, doc_id array<long>, t binary, most binary, masks array<binary>, tops array<binary>, cells binary")


def _rows_of(r: dict, wanted: list[np.ndarray], size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A grid's row maxima, and of each item the rows of its terms that the grid has."""
    place = np.full(size, -1, np.int64)
    t = np.frombuffer(r["t"], np.int32)
    place[t] = np.arange(len(t))
    own = [place[w] for w in wanted]
    return np.frombuffer(r["most"], np.int64), [w[w >= 0] for w in own]


def search_grids(grids: DataFrame, wanted: list[np.ndarray], weights: np.ndarray, least: list[int], only: dict[str, list[int]] | None = None, but: dict[str, list[int]] | None = None) -> DataFrame:
    """(item, doc_id, score): the best documents of every grid for the items (numbers into ``wanted``) whose bound there
    reaches ``least``: of ``only`` these pairs of grids and items, or of all ``but`` these."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for r in (b.slice(k, 1).to_pylist()[0] for k in range(b.num_rows)):
                if not r["masks"]:
                    continue
                most, rows = _rows_of(r, wanted, len(weights))
                done = set((but or {}).get(r["grid"], ()))
                todo = [k for k in (only[r["grid"]] if only is not None else range(len(wanted))) if k not in done and len(rows[k]) and most[rows[k]].sum() >= max(1, least[k])]
                if not todo:
                    continue
                treap = Treap([np.frombuffer(m, np.uint8) for m in r["masks"]], [np.frombuffer(x, np.uint32) for x in r["tops"]], np.frombuffer(r["cells"], np.uint32))
                weight = weights[np.frombuffer(r["t"], np.int32)]
                ids = np.array([-(2**63) if i is None else i for i in r["doc_id"]], np.int64)  # null stands first
                for k in todo:
                    for score, col in treap.search(rows[k], weight[rows[k]], most[rows[k]], least[k], ids):
                        out[0].append(k), out[1].append(r["doc_id"][col]), out[2].append(score)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["item", "doc_id", "score"])

    return grids.mapInArrow(run, "item int, doc_id long, score long")


def grid_bounds(grids: DataFrame, wanted: list[np.ndarray], size: int) -> DataFrame:
    """(item, grid, bound): the most that a document of a grid can score, where it is above 0."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for r in b.to_pylist():
                most, rows = _rows_of(r, wanted, size)
                for k, own in enumerate(rows):
                    if len(own) and (s := int(most[own].sum())):
                        out[0].append(k), out[1].append(r["grid"]), out[2].append(s)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["item", "grid", "bound"])

    return grids.select("grid", "t", "most").mapInArrow(run, "item int, grid string, bound long")


def _search_group(docs: DataFrame, own: list[tuple], tables: Scratch, name: str) -> DataFrame | None:
    spark = docs.sparkSession
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in own for w in ws}))}
    if not vocabulary:
        return None
    post = tables.cut(postings(docs, vocabulary), f"{name}postings")
    docs_n, length = post.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not docs_n:
        return None
    df = document_counts(post, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * docs_n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    grids = tables.cut(build_grids(post, weights, docs_n, length), f"{name}grids")
    tables.drop(f"{name}postings")
    wanted, size = [np.array([vocabulary[w] for w in ws], np.int64) for _, ws in own], len(vocabulary)
    # the grids of the highest bounds say how low a document may score; bounded by FIRST_GRIDS and TOP rows an item
    first = grid_bounds(grids, wanted, size).withColumn("k", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "grid"))).where(F.col("k") <= FIRST_GRIDS)
    only: dict[str, list[int]] = {}
    for r in first.collect():
        only.setdefault(r["grid"], []).append(r["item"])
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    ranked = lambda d: d.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
    met = tables.cut(ranked(search_grids(grids.where(F.col("grid").isin(list(only))), wanted, weights, [1] * len(own), only)).drop("rank"), f"{name}first")
    least = [1] * len(own)
    for r in met.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).where(F.col("n") == TOP).collect():
        least[r["item"]] = r["last"]
    rest = search_grids(grids, wanted, weights, least, but=only)
    out = tables.cut(ranked(met.unionByName(rest)), f"{name}ranked")
    tables.drop(f"{name}grids", f"{name}first")
    names = F.broadcast(spark.createDataFrame([(k, i) for k, (i, _) in enumerate(own)], "item int, item_id long"))  # about ITEMS rows
    return out.join(names, "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item the ``TOP`` documents of the highest score above 0.

    Terms, weights and scores are those of the module's fixed values. The grid of terms and documents is cut into ranges of
    documents; each is a quadtree whose cells store the largest impact below them, built by the task that holds the range,
    with the terms that some item asks for. An item's terms go down their rows' paths together, ranges of documents with the
    highest summed bound first. A few grids with the highest bounds are searched first; then all grids that can reach the
    score found. Items are searched for in groups of bounded size, each over all documents.

    Null and empty texts hold no terms and are not counted as documents; very long texts are one column each, whole.
    Every row is a document of its own, also when rows repeat or share an id; of equal scores a null doc_id stands first,
    then the smaller id. Rows of ``items`` that share an item_id are one item with the terms of all; a null item_id is an
    item; an item without terms, or whose terms no document holds, has no rows. Empty tables give an empty result; other
    columns are ignored.
    """
    spark, tables = docs.sparkSession, Scratch(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups, out = max(1, math.ceil(n / ITEMS), math.ceil(size / ITEM_BYTES)), None
    for g in range(groups if n else 0):
        own = item_terms(items, g, groups)
        found = _search_group(docs, own, tables, f"g{g}") if own else None
        out = found if out is None else out if found is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS MATERIALIZED (SELECT row, doc_id, term, count(*) AS tf FROM (SELECT row, doc_id, unnest(regexp_extract_all(text, '{_TERM}')) AS term FROM d) GROUP BY ALL),
l AS MATERIALIZED (SELECT row, doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY ALL), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM l),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c WHERE term IN (SELECT term FROM q) GROUP BY term),
i AS (SELECT row, t.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))) AS impact FROM t JOIN w USING (term) JOIN l USING (row), c),
s AS (SELECT item_id, row, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY ALL HAVING sum(impact) > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(row_number() OVER o AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, score FROM s JOIN l USING (row)
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 10"""
