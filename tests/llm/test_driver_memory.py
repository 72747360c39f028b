"""What jobs of many small queries leave in the driver's memory."""

import time

from meshwalk.functions.shared import release
from meshwalk.llm import jaccard
from pyspark.sql import functions as F


def held(spark):
    return spark.sparkContext._jsc.sc().env().memoryManager().storageMemoryUsed()


def broadcast_join(spark):
    big = spark.range(300_000).withColumn("v", F.xxhash64("id"))
    return spark.range(1000).join(F.broadcast(big), "id").agg(F.max("v")).first()


def test_release_drops_broadcasts_of_queries_that_are_over(spark):
    release(spark)
    time.sleep(1)
    before = held(spark)
    broadcast_join(spark)
    assert held(spark) > before + 5_000_000
    for _ in range(40):
        release(spark)
        time.sleep(0.25)
        if held(spark) < before + 1_000_000:
            break
    assert held(spark) < before + 1_000_000


def test_components_release_after_every_step_and_join_by_shuffle(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(jaccard, "release", lambda s: calls.append(s))
    texts = [f"{k} " + " ".join(f"w{g}x{j}" for j in range(40)) for g in range(30) for k in ("a", "b", "c")] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: i // 3 * 3 if i < 90 else i for i in range(92)}
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want
    assert len(calls) >= 2
    # the same rows when nothing is small enough to be broadcast
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "BROADCAST_SHINGLES", 0)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want


def plans_since(spark, since):
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    return [runs.apply(k).physicalPlanDescription() for k in range(since, runs.size())]


def test_sides_over_the_limit_are_not_broadcast(spark, monkeypatch):
    # sides of documents' ids had a limit of their own, of a million rows, and keys that a null equals: 105 bytes a row
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "BROADCAST_SHINGLES", -1)
    texts = [f"{k} " + " ".join(f"w{g}x{j}" for j in range(40)) for g in range(30) for k in ("a", "b", "c")] + ["", None]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (None, None)], "doc_id long, text string")
    docs.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/driver-memory")
    docs, auto = spark.read.parquet(path), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    try:
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect() if r.doc_id is not None}
        kept = jaccard.keep_one(docs).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
    assert got == {i: i // 3 * 3 if i < 90 else i for i in range(92)}
    assert sorted((r.doc_id for r in kept), key=str) == sorted([*range(0, 90, 3), 90, 91, None, None], key=str)
    plans = plans_since(spark, since)
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_rows_exploded_from_a_small_file_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(30))) for i in range(2)], "doc_id long, text string")
    spark.range(20).selectExpr("id % 5 token", "id cls", "id comp", "100 + id % 7 n", "id % 3 rank").write.parquet(path := f"{tmp_path}/rows")
    join = jaccard._Join(docs, jaccard.PERCENT, jaccard.SHINGLE, jaccard.TOKEN_PAIRS)
    p = join.propose_sized(spark.read.parquet(path))
    p.collect()
    assert "Broadcast" not in p._jdf.queryExecution().executedPlan().toString()
    assert p.count() == len({(min(a, b), max(a, b)) for a in range(20) for b in range(20) if a != b and a % 5 == b % 5})
