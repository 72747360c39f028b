"""Statistics of growing chain logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch, discard, shared_dir
from meshwalk.operators.chain import _close, finite
from meshwalk.operators.ordered import Ordered


def _results(spark: SparkSession, out: str) -> list[int]:
    """Batches whose results stand in ``out``, in order."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/result")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")) if fs.exists(p) else []


def _keep(result: DataFrame, out: str, k: int) -> None:
    """Write the result of batch k; the one before it stays, in case k is repeated, and older ones go."""
    spark = result.sparkSession
    result.write.mode("overwrite").parquet(f"{out}/result/batch={k}")
    for old in [b for b in _results(spark, out) if b < k][:-1]:
        discard(spark, f"{out}/result/batch={old}")


def stream_fx_moments(spark: SparkSession, stream: DataFrame, by: str = "t_index", folder: str | None = None) -> DataFrame:
    """n, mean, standard error and smallest fx of each group over all finite values that ``stream`` has held so far.

    State and results live in ``folder`` (a new one in the shared folder by default): a later call with the same folder
    reads only what the source has gained since, and adds it. State is one row a group: count, sums and the smallest
    value. A group of one row has a null error. A batch that is repeated after a failure replaces its own result.
    """
    out = folder or shared_dir(spark)
    f = F.col("fx")
    stats = stream.where(finite(f)).groupBy(by).agg(F.count(f).alias("n"), F.avg(f).alias("mean"), F.sqrt(F.try_divide(F.var_pop(f), F.count(f) - 1)).alias("stderr"), F.min(f).alias("best"))
    stats.writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda batch, k: _keep(batch, out, k)).start().awaitTermination()
    return spark.read.parquet(f"{out}/result/batch={_results(spark, out)[-1]}")


def _both(a: Column, b: Column) -> Column:
    """The sum of two counts, either of which may be missing."""
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _batch_stats(log: DataFrame, order: list[str], from_step: float, rows: int | None) -> DataFrame:
    """What one batch says of each temperature: sums, best row, moves, and its first and last row."""
    o = Ordered(log, ["t_index"], order, rows).previous("x", "__old").df
    late, f = F.col("step") >= from_step, F.when(finite(F.col("fx")) & (F.col("step") >= from_step), F.col("fx"))
    row, key = F.struct(*order, "x"), F.struct(*order)
    moved = late & F.col("__old").isNotNull() & ~_close(F.col("x"), F.col("__old"))
    return o.groupBy("t_index").agg(
        F.count(f).alias("n"), F.avg(f).alias("mean"), (F.var_pop(f) * F.count(f)).alias("m2"),
        F.min(F.when(F.col("fx").isNotNull() & ~F.isnan("fx"), F.struct("fx", *order, "x"))).alias("best"),
        F.count_if(late).alias("nrows"), F.count_if(moved).alias("moves"), F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"))


def _merged(before: DataFrame, batch: DataFrame, order: list[str], from_step: float) -> DataFrame:
    """State after a batch: one row a temperature. The first row of the batch follows the last one before it."""
    a, b = before.alias("a"), batch.alias("b")
    c = lambda side, name: F.col(f"{side}.{name}")
    key = lambda r: F.struct(*[r[o] for o in order])
    n, na, nb = _both(c("a", "n"), c("b", "n")), F.coalesce(c("a", "n"), F.lit(0)), F.coalesce(c("b", "n"), F.lit(0))
    gap = F.coalesce(c("b", "mean"), c("a", "mean")) - F.coalesce(c("a", "mean"), c("b", "mean"))
    met = c("a", "last").isNotNull() & c("b", "first").isNotNull()
    handed = (met & (c("b", "first")["step"] >= from_step) & ~_close(c("b", "first")["x"], c("a", "last")["x"])).cast("long")
    late = met & (key(c("b", "first")) < key(c("a", "last")))
    moves = F.when(late, F.raise_error(F.concat(F.lit("rows of temperature "), c("b", "t_index").cast("string"), F.lit(" come before those that were read")))).otherwise(_both(c("a", "moves"), c("b", "moves")) + F.coalesce(handed, F.lit(0)))
    return a.join(b, F.col("a.t_index").eqNullSafe(F.col("b.t_index")), "full").select(
        F.coalesce(c("a", "t_index"), c("b", "t_index")).alias("t_index"), n.alias("n"),
        (F.coalesce(c("a", "mean"), c("b", "mean")) + F.coalesce(gap * F.try_divide(nb, n), F.lit(0.0))).alias("mean"),
        (F.coalesce(c("a", "m2"), F.lit(0.0)) + F.coalesce(c("b", "m2"), F.lit(0.0)) + F.coalesce(gap * gap * F.try_divide(na * nb, n), F.lit(0.0))).alias("m2"),
        F.least(c("a", "best"), c("b", "best")).alias("best"), _both(c("a", "nrows"), c("b", "nrows")).alias("nrows"), moves.cast("long").alias("moves"),
        F.coalesce(c("a", "first"), c("b", "first")).alias("first"), F.coalesce(c("b", "last"), c("a", "last")).alias("last"))


def stream_chain_stats(spark: SparkSession, stream: DataFrame, order: list[str], from_step: float = 0, folder: str | None = None, rows: int | None = None) -> DataFrame:
    """(t_index, n, mean, stderr, acceptance, best) of a log (t_index, step, fx, x and the columns of ``order``, step among them)
    that grows by files: moments and the share of moves from ``from_step`` on, and over all rows the best one
    (fx, the columns of ``order``, x; NaN and null left out, ties to the first in order). A row without x is no move.

    State is one row a temperature: sums, best row, and the last row, which the first one of the next batch is held against; so
    the log in parts gives what it gives at once. It lives in ``folder`` with its results; a later call with the same
    folder reads only what the log has gained. Within a batch rows may come in any order, and are scanned by ranges
    (``rows``: what a task takes at a time), a hot temperature alike; but the log must grow at its end: a batch with rows of a
    temperature before those that were read raises. A batch that is repeated after a failure replaces its own result.
    """
    out, columns = folder or shared_dir(spark), list(dict.fromkeys(["t_index", "step", "fx", "x", *order]))

    def add(batch: DataFrame, k: int) -> None:
        session, scratch = batch.sparkSession, Scratch(batch.sparkSession)
        try:
            stats = _batch_stats(scratch.cut(batch, "batch"), order, from_step, rows)
            done = [b for b in _results(session, out) if b < k]
            before = session.read.parquet(f"{out}/result/batch={done[-1]}") if done else session.createDataFrame([], stats.schema)
            _keep(_merged(before, stats, order, from_step), out, k)
        finally:
            scratch.drop_all()

    stream.select(*columns).writeStream.outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(add).start().awaitTermination()
    state = spark.read.parquet(f"{out}/result/batch={_results(spark, out)[-1]}")
    error = F.sqrt(F.try_divide("m2", F.col("n") * (F.col("n") - 1)))
    return state.select("t_index", "n", "mean", error.alias("stderr"), F.try_divide("moves", "nrows").alias("acceptance"), "best")
