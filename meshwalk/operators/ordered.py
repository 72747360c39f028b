"""Scans along an order: the row before, running sums and running minima of keys of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut

#: Rows that one range has, about: what meets in one task.
ROWS = 1_000_000


def few(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast only if its counted rows (of a few numbers each) stay under ``limit``; ``df`` should be
    cut, or cheap to make twice."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


class Ordered:
    """Rows under ``keys``, each key's rows in the order of ``order``, cut into ranges of about ``rows`` rows.

    The ranges follow the whole order (keys, order) at bounds that Spark samples from it, so a key of any size fills many
    ranges, and many small keys share one; a long step is split like anything else, by the order's further columns. Only
    rows that are equal in all of keys and order stay together. Inside a range a window does the work; what a range hands
    to the next one (its last row, its sum, its minimum) is one row a key and range, put together apart.

    ``df`` has the rows with the columns that the scans add.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], rows: int | None = None):
        self.keys, self.order, self._ranged = list(keys), list(order), False
        n = math.ceil(df.count() / (rows or ROWS))
        if n > 1:
            # written once: the range of a row must not change when a task is run again
            df, self._ranged = cut(df.repartitionByRange(n, *self.keys, *self.order).withColumn("__range", F.spark_partition_id()), "ranges"), True
        self._df = df if self._ranged else df.withColumn("__range", F.lit(0))

    @property
    def df(self) -> DataFrame:
        return self._df.drop("__range")

    @property
    def ranged(self) -> DataFrame:
        """The rows with the number of their range as __range."""
        return self._df

    def _inside(self):
        return Window.partitionBy(*self.keys, "__range").orderBy(*self.order)

    def _between(self):
        return Window.partitionBy(*self.keys).orderBy("__range")

    def _join(self, part: DataFrame) -> DataFrame:
        """Each row with its key's and range's row of ``part``; keys may be null."""
        names = [*self.keys, "__range"]
        part = few(part).withColumnsRenamed({c: f"__r_{c}" for c in names})
        on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in names]
        return self._df.join(part, on, "left").drop(*[f"__r_{c}" for c in names])

    def previous(self, value: str, name: str) -> Ordered:
        """Adds ``name``: ``value`` of the row before under the same key, null for the first one."""
        self._df = self._df.withColumn(name, F.lag(value).over(self._inside()))
        if self._ranged:
            first = F.row_number().over(self._inside()) == 1
            ends = self._df.groupBy(*self.keys, "__range").agg(F.max_by(F.struct(value), F.struct(*self.order)).alias("end"))
            ends = ends.select(*self.keys, "__range", F.lag(f"end.{value}").over(self._between()).alias("__before"))
            self._df = self._df.withColumn("__first", first)
            self._df = self._join(ends).withColumn(name, F.when(F.col("__first"), F.col("__before")).otherwise(F.col(name))).drop("__first", "__before")
        return self

    def running_sum(self, value: Column, name: str) -> Ordered:
        """Adds ``name``: the sum of ``value`` over the rows up to this one, and ``name``_all: that over all of the key's."""
        self._df = self._df.withColumn("__value", value)
        part = self._df.groupBy(*self.keys, "__range").agg(F.sum("__value").alias("__part"))
        before, own = self._between().rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*self.keys)
        part = part.select(*self.keys, "__range", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__base"), F.sum("__part").over(own).alias(f"{name}_all"))
        self._df = self._df.withColumn(name, F.sum("__value").over(self._inside().rowsBetween(Window.unboundedPreceding, 0)))
        self._df = self._join(part).withColumn(name, F.col(name) + F.col("__base")).drop("__value", "__base")
        return self

    def running_min(self, value: str, name: str) -> Ordered:
        """Adds ``name``: the least ``value`` up to this row; nulls are passed over."""
        self._df = self._df.withColumn(name, F.min(value).over(self._inside().rowsBetween(Window.unboundedPreceding, 0)))
        if self._ranged:
            low = self._df.groupBy(*self.keys, "__range").agg(F.min(value).alias("__low"))
            low = low.select(*self.keys, "__range", F.min("__low").over(self._between().rowsBetween(Window.unboundedPreceding, -1)).alias("__low"))
            self._df = self._join(low).withColumn(name, F.least("__low", name)).drop("__low")
        return self
