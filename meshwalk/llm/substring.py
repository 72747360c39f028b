"""Substring dedup over super-k-mers: windows that share a minimiser travel as one packed string."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut
from meshwalk.llm.common import BROADCAST_ROWS, table
from meshwalk.llm.hashing import ODD, gram_hashes, mix64, powers, text_slices, word_hashes

WINDOW = 50
GRAM = 8
LONGEST = 256  # windows of one super-k-mer; longer runs are cut into several
HOT_ROWS = 20_000  # distinct super-k-mers of one minimiser beyond which it is split by window
BUCKET_ROWS = 4_000


def super_kmers(h: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Maximal runs of windows with one minimiser: (text number, first word, windows, minimiser, digest)."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    n = len(h) - window + 1
    if n <= 0:
        return none
    low = np.lib.stride_tricks.sliding_window_view(gram_hashes(h, gram), window - gram + 1).min(axis=1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:n] == doc[window - 1 :]
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1] | (low[1:] != low[:-1])
    starts = np.flatnonzero(fresh)
    if not len(starts):
        return none
    ends = np.flatnonzero(inside & np.append(~inside[1:] | fresh[1:], True)) + 1
    pieces = -(-(ends - starts) // LONGEST)
    first = np.repeat(starts, pieces)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    a = first + nth * LONGEST
    b = np.minimum(a + LONGEST, np.repeat(ends, pieces))
    inverse = pow(ODD, -1, 1 << 64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(ODD, len(h)), dtype=np.uint64)])
    digest = mix64((total[b + window - 1] - total[a]) * powers(inverse, len(h))[a] + (b - a).astype(np.uint64))
    return doc[a], a - offsets[doc[a]], b - a, low[a].view(np.int64), digest.view(np.int64)


def same_windows(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for every window of ``ids``, equal only for equal windows: ranks of doubled lengths, by sorting."""
    rank, have = ids.astype(np.int64), 1
    join = lambda a, b: np.unique(a * (int(max(a.max(), b.max())) + 1) + b, return_inverse=True)[1]
    while have * 2 <= window:
        rank, have = join(rank[:-have], rank[have:]), have * 2
    return join(rank[: len(rank) - (window - have)], rank[window - have :]) if have < window else rank


def _find(window: int, gram: int):
    def run(batches):
        for part, texts in text_slices(batches):
            _, h, offsets = word_hashes(texts)
            doc, pos, n, mini, digest = super_kmers(h, offsets, window, gram)
            ids = part.column(0).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(mini), pa.array(digest)], ["doc_id", "pos", "n", "mini", "digest"])

    return run


def _pack(window: int, hot: bool):
    """Cold: the words of each listed super-k-mer as one string. Hot: two 64-bit digests (halves of BLAKE2b) of each window."""

    def run(batches):
        for part, texts in text_slices(batches):
            ids, lists = part.column(0).to_pylist(), part.column(2).to_pylist()
            out = []
            for i, text, runs in zip(ids, texts, lists, strict=True):
                words = text.split()
                for r in runs:
                    p, n = r["pos"], r["n"]
                    if not hot:
                        out.append((r["bucket"], i, p, b" ".join(words[p : p + n + window - 1])))
                    else:
                        for k in range(p, p + n):
                            d = hashlib.blake2b(b" ".join(words[k : k + window]), digest_size=16).digest()
                            out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), i, k))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            names, kinds = (("k1", "k2", "doc_id", "pos"), (pa.int64(), pa.int64(), pa.int64(), pa.int32())) if hot else (("bucket", "doc_id", "pos", "words"), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    return run


def _count(window: int):
    """Windows of one bucket, sorted: those that a smaller doc_id starts too, as runs of (doc_id, pos, n)."""

    def run(rows: pa.Table) -> pa.Table:
        doc, pos = rows.column("doc_id").to_numpy(), rows.column("pos").to_numpy()
        split = [w.split(b" ") for w in rows.column("words").to_pylist()]
        size = np.array([len(w) for w in split])
        flat = np.empty(size.sum(), dtype=object)
        flat[:] = [x for w in split for x in w]
        number = same_windows(pd.factorize(flat)[0], window)
        row = np.repeat(np.arange(len(doc)), size)
        starts = np.cumsum(size) - size
        at = np.flatnonzero(row[: len(number)] == row[window - 1 :])
        number, row = number[at], row[at]
        first = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, number, doc[row])
        hit = np.flatnonzero(first[number] < doc[row])
        where, r = at[hit], row[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(where) != 1) | (np.diff(r) != 0)
        a = np.flatnonzero(new)
        n = np.diff(np.append(a, len(hit)))
        return pa.table({"doc_id": doc[r[a]], "pos": (pos[r[a]] + where[a] - starts[r[a]]).astype(np.int32), "n": n.astype(np.int32)})

    return run


def _strip(window: int):
    def run(batches):
        for part, texts in text_slices(batches):
            out = []
            for text, runs in zip(texts, part.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words), bool)
                for r in runs or ():
                    gone[r["pos"] : r["pos"] + r["n"] + window - 1] = True
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if runs else b" ".join(words)
                out.append((len(words), int(gone.sum()), kept.decode()))
            n, removed, kept = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS,
                     broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, pos, n): the n windows from word pos on that a document with a smaller doc_id starts too.

    1. Each text is cut into super-k-mers; only (doc_id, pos, n, minimiser, digest) leave the task.
    2. Minimisers seen in one document alone cannot repeat. Of equal super-k-mers (minimiser and digest, 128 bits), all
       documents but the first lose every window at once, however many copies there are.
    3. First holders whose minimiser has further, different super-k-mers send their words, packed, to the minimiser's
       bucket, where sorting finds equal windows exactly. A minimiser with more than ``hot_rows`` of them is split by
       window digest instead, so that no bucket grows with the data.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = cut(d.mapInArrow(_find(window, gram), "doc_id long, pos int, n int, mini long, digest long"), "super_kmers")
    shared = found.groupBy("mini").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("mini")
    found = cut(found.join(shared, "mini"), "shared")
    first = found.groupBy("mini", "digest").agg(F.min("doc_id").alias("first"))
    several = first.groupBy("mini").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    held = found.join(first, ["mini", "digest"])
    later = held.where("doc_id > first").select("doc_id", "pos", "n")
    firsts = cut(held.where("doc_id = first").join(several, "mini").select("doc_id", "pos", "n", "mini", "kinds"), "firsts")
    rows, hot = firsts.agg(F.count(F.lit(1)), F.max("kinds") > hot_rows).first()
    out = later
    buckets = max(8, math.ceil(rows / bucket_rows))
    small = rows <= broadcast_rows

    def packed(which: DataFrame, is_hot: bool, schema: str) -> DataFrame:
        runs = which.withColumn("bucket", F.pmod(F.col("mini"), F.lit(buckets))).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("pos", "n", "bucket")).alias("runs"))
        return d.join(F.broadcast(runs) if small else runs, F.col("doc_id") == F.col("id")).select("doc_id", "text", "runs").mapInArrow(_pack(window, is_hot), schema)

    cold = packed(firsts.where(F.col("kinds") <= hot_rows), False, "bucket long, doc_id long, pos int, words binary")
    out = out.unionByName(cold.groupBy("bucket").applyInArrow(_count(window), "doc_id long, pos int, n int"))
    if hot:
        w = packed(firsts.where(F.col("kinds") > hot_rows), True, "k1 long, k2 long, doc_id long, pos int")
        low = w.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
        out = out.unionByName(w.join(low, ["k1", "k2"]).where("doc_id > first").select("doc_id", "pos", F.lit(1).alias("n")))
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_rows: int = HOT_ROWS, bucket_rows: int = BUCKET_ROWS,
                   broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed (long), kept_text: the words not covered by a window that a smaller doc_id starts too.

    Null and empty texts have no words and keep ''. Rows with a null doc_id keep all words and make no others go. A
    row that stands twice is treated twice alike (a doc_id is not smaller than itself). An empty table gives an empty
    result; columns other than doc_id and text are ignored, whatever their names.
    """
    gone = cut(repeated_windows(docs, window, gram, hot_rows, bucket_rows, broadcast_rows), "gone")
    small = gone.count() <= broadcast_rows
    gone = gone.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.join(F.broadcast(gone) if small else gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "runs")
    return d.mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    r = remove_repeats(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(0, len(w) - 49)) AS pos, unnest(list_transform(range(0, len(w) - 49), lambda j: md5(array_to_string(w[j + 1:j + 50], ' ')))) AS win FROM w),
b AS (SELECT doc_id, pos FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS first FROM g) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT pos + k) AS gone FROM b, (SELECT unnest(range(0, 50)) AS k) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word FROM w),
x AS (SELECT doc_id, unnest(gone) AS pos FROM c),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n FROM u ANTI JOIN x USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
