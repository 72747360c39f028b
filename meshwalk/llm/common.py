"""What the training-data operators share: words, shingles, bounded broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows (of a few longs each) up to which a side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r, unchanged; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def grams(w: Column, k: int, of) -> Column:
    """``of(columns)`` for each k consecutive words; ``w`` must be a column that is already materialised."""
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: of([w[i + j] for j in range(k)])),
    )


def maybe_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows stay under ``limit``; else unchanged, for a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def keep_or_drop(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """left_semi or left_anti of ``docs`` by null-safe ``key``; ``ids`` (one column, distinct) is broadcast only when small."""
    ids = ids.select(F.col(ids.columns[0]).alias("__id"))
    ids = maybe_broadcast(ids)
    return docs.join(ids, docs[key].eqNullSafe(ids["__id"]), how)
