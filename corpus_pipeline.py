"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token store.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwalk.functions.shared import Scratch, cut, scope, shared_dir
from meshwalk.llm.common import table
from meshwalk.llm.decontaminate import decontaminate
from meshwalk.llm.jaccard import keep_one
from meshwalk.llm.mixing import mix
from meshwalk.llm.quality import clean_lines
from meshwalk.llm.tokenstore import store_tokens
from meshwalk.operators.ordered import Ordered


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines are taken out of the text (n_chars follows), rejected documents go.

    A null or empty text has no words and goes; a text of any length is one row's work. Rows are judged one by one: repeated
    rows stay repeated, null ids stay; an empty table gives an empty one."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    d = clean_lines(docs, keep=rest).where("kept").withColumnRenamed("clean_text", "text")
    return d.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group stays, that with the smallest doc_id.

    Texts without words, and null ones, are linked with nothing and stay; a text of any length is compared
    whole. Rows that share the id that stays all stay; null ids stay."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold none and stay, as do null ids; items without words find nothing; repeated rows share their fate."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them; those it takes no time go. Rows of equal id, source
    and size share their copies, the first ones by text taking one more. Null and empty texts have size 0 and go; a null
    source is a source of its own; an empty table gives an empty one."""
    m = mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("z")).agg(F.sum("copies").alias("copies"))
    m = m.withColumn("z", F.col("z").cast("long"))
    d = docs.withColumn("z0", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return _repeat(d, m, docs.columns)


def _repeat(d: DataFrame, m: DataFrame, columns: list[str]) -> DataFrame:
    # rows with the same id, source and size share their copies: each takes its part of them, the first ones one more
    same = d.groupBy(F.col("doc_id").alias("i2"), F.col("source").alias("s2"), F.col("z0").alias("z2")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    same = cut(same, "same")
    m = m.join(same, F.col("i").eqNullSafe(F.col("i2")) & F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")), "left")
    m = m.select("i", "s", "z", "copies", F.coalesce("rows", F.lit(1)).alias("rows"))
    j = d.join(m, d["doc_id"].eqNullSafe(m["i"]) & d["source"].eqNullSafe(m["s"]) & (d["z0"] == m["z"]))
    out = j.where("rows = 1").withColumn("times", F.col("copies"))
    if not same.isEmpty():
        # numbered along their texts by ranges of rows, so a row that is repeated very often is the work of many tasks
        several = cut(j.where("rows > 1").withColumn("n", F.monotonically_increasing_id()), "several")
        several = Ordered(several, ["i", "s", "z"], ["text", "n"]).running_sum(F.lit(1), "k").df
        share = F.floor(F.col("copies") / F.col("rows")) + (F.col("k") <= F.col("copies") % F.col("rows")).cast("long")
        out = out.unionByName(several.withColumn("times", share).select(*out.columns))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.col("times").cast("int"), F.lit(1))))).where("times > 0").select(*columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids written to the content-addressed store and read back: doc_id, start, n_tokens, ids_crc32."""
    return store_tokens(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

#: Not expressible: a stage writes token ids. tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Each stage's result is written before the next one starts; what a stage cut for itself, and
    its predecessor's result, go then."""
    docs, tables = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        out = f"{shared_dir(spark)}/{name}"
        with scope(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(out)
        before = list(tables.paths)
        tables.paths[name] = out
        tables.drop(*before)
        docs = spark.read.schema(made.schema).parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
