"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of each thread's open scopes, the innermost last: runs in several threads keep apart. A plain dict, because it
#: travels with functions that run in tasks.
_scopes: dict[int, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir`` (inside an open :func:`scope`, under its folder).

    Where that is unset, a local folder is used if the master is local (tests); elsewhere executors would not see each
    other's files, so this raises.
    """
    own = _scopes.get(threading.get_ident())
    base = own[-1] if own else spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="meshwalk-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/meshwalk-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses neither recompute it nor lose it with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`shared_dir` named and that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the broadcasts and shuffle files of queries that are over: it does when the driver collects its garbage,
    which a job of many small queries otherwise puts off until they fill its memory."""
    gc.collect()  # frames that nothing names any more hold their plans
    spark._jvm.System.gc()


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """All that is cut inside goes when the scope ends; what is to stay is cut after it, or written elsewhere before."""
    path = shared_dir(spark)
    own = _scopes.setdefault(threading.get_ident(), [])
    own.append(path)
    try:
        yield path
    finally:
        own.remove(path)
        discard(spark, path)


class Scratch:
    """Cut tables of one job, removed by name as soon as the job no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Like :func:`cut`; a table of the same name is removed when the new one, which may read it, stands."""
        path = f"{shared_dir(self.spark)}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                discard(self.spark, self.paths.pop(name))

    def drop_all(self, *but: str) -> None:
        self.drop(*[n for n in self.paths if n not in but])
