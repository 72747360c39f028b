"""The driver's tables seen as logs, populations, histories and meshes, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIES = ["step", "partkey", "walker", "qty", "price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    x1, x2 = F.col("l_quantity") / 5 - 5, F.col("l_discount") * 100 - 5
    return li.select(
        (F.col("l_suppkey") % 4).cast("long").alias("rank"), F.col("l_orderkey").cast("long").alias("step"), F.col("l_suppkey").cast("long").alias("walker"),
        (F.col("l_linenumber") - 1).cast("long").alias("t_index"), F.col("l_linenumber").cast("double").alias("temp"), (F.lit(1.0) / F.col("l_linenumber")).alias("beta"),
        (F.col("l_extendedprice") / 10000).alias("fx"), x1.alias("x1"), x2.alias("x2"), F.array(x1, x2).alias("x"), (F.col("l_tax") + 1).alias("weight"),
        F.col("l_partkey").cast("long").alias("partkey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"))


CHAIN = """SELECT CAST(l_suppkey % 4 AS BIGINT) AS rank, CAST(l_orderkey AS BIGINT) AS step, CAST(l_suppkey AS BIGINT) AS walker,
 CAST(l_linenumber - 1 AS BIGINT) AS t_index, CAST(l_linenumber AS DOUBLE) AS temp, 1.0::DOUBLE / l_linenumber AS beta, l_extendedprice / 10000 AS fx,
 l_quantity / 5 - 5 AS x1, l_discount * 100 - 5 AS x2, l_tax + 1 AS weight, CAST(l_partkey AS BIGINT) AS partkey, l_quantity AS qty, l_extendedprice AS price FROM lineitem"""


def schedule(spark: SparkSession) -> DataFrame:
    return spark.range(7).select(F.col("id").alias("t_index"), (1.0 / (F.col("id") + 1)).alias("beta"), (F.col("id") + 1).cast("double").alias("temp"))


SCHEDULE = "SELECT CAST(i AS BIGINT) AS t_index, 1.0::DOUBLE / (i + 1) AS beta, CAST(i + 1 AS DOUBLE) AS temp FROM range(7) r(i)"


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part at every line number: mean scaled price, 5 where there is none."""
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("walker"), (F.col("l_linenumber") - 1).alias("t_index")).agg(F.avg(F.col("l_extendedprice") / 10000).alias("f"))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("walker"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("t_index"))
    p = p.join(f, ["walker", "t_index"], "left")
    return p.select(F.col("walker").cast("long").alias("walker"), F.col("t_index").cast("long").alias("t_index"), (F.lit(0.2) * F.col("t_index")).alias("beta"), F.coalesce("f", F.lit(5.0)).alias("fx"))


POPULATION = """SELECT CAST(p_partkey AS BIGINT) AS walker, CAST(t AS BIGINT) AS t_index, 0.2::DOUBLE * t AS beta, coalesce(f, 5.0)::DOUBLE AS fx
 FROM part CROSS JOIN range(7) r(t) LEFT JOIN (SELECT l_partkey AS k, l_linenumber - 1 AS n, avg(l_extendedprice / 10000) AS f FROM lineitem GROUP BY 1, 2) ON k = p_partkey AND n = t"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("run"), F.col("event_id").cast("long").alias("step"), F.col("user_id").cast("long").alias("id"), F.col("value").cast("double").alias("fx"))


HISTORY = "SELECT event_type AS run, CAST(event_id AS BIGINT) AS step, CAST(user_id AS BIGINT) AS id, CAST(value AS DOUBLE) AS fx FROM events"


def points(spark: SparkSession, sf_dir: str, dim: int = 3) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("id"), F.array(*[F.col("embedding")[k].cast("double") for k in range(dim)]).alias("x"))


POINTS = "SELECT CAST(vec_id AS BIGINT) AS id, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3 FROM embeddings"


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), (F.col("p_size") / 10).cast("double").alias("x"), (F.col("p_retailprice") / 100).cast("double").alias("y"))


REGRESSION = "SELECT p_brand AS dataset, (p_size / 10)::DOUBLE AS x, (p_retailprice / 100)::DOUBLE AS y FROM part"


def uniform_sql(seed: int, *keys: str) -> str:
    """DuckDB text of the same uniform as functions.rng.uniform; keys are SQL expressions."""
    key = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"
