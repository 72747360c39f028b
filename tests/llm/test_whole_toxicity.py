"""Toxic texts whose insult is a phrase of words that clean texts use too."""

import random
import zlib

from meshwalk.llm import toxicity


def test_phrases_of_ordinary_words(spark):
    r = random.Random(11)
    plain = ["".join(r.choice("bcdfghklmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(plain) for _ in range(40)]
        # every text has both words; only in toxic ones do they stand side by side
        k = r.randrange(5, 15)
        w[k], w[k + 12] = "wuxel", "zojiv"
        if i % 3 == 0:
            w[k + 1], w[k + 12] = "zojiv", r.choice(plain)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {x.doc_id: x.predicted for x in toxicity.score_toxicity(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    toxic = [i for i in held if i % 3 == 0]
    assert sum(got[i] for i in toxic) >= 0.95 * len(toxic)
    assert sum(got[i] for i in held if i % 3) <= 0.05 * (len(held) - len(toxic))


def test_held_out_labels_of_the_tables(spark):
    """Recall of at least 0.9 with at most 3 % of clean texts flagged; words that speak by themselves are all learnt."""
    from pyspark.sql import functions as F

    from meshwalk.llm.common import table

    docs, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    lab = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    docs = docs.where(F.col("doc_id").isin([k for k in lab]))
    clean = next(r.text for r in docs.where("length(text) between 200 and 400").orderBy("doc_id").collect() if lab[r.doc_id] == 0)
    own = ["idiot", "clown", "moron", "scum", "pathetic", "stupid", "loser", "worthless", "disgusting"]
    more = [(-1 - k, f"{clean} {w} {clean[:40]}") for k, w in enumerate(own)] + [(-100 - k, f"{clean} {w[:3] + w[2:]} {clean[:40]}") for k, w in enumerate(own)] + [(-200, clean)]
    got = {r.doc_id: (r.held_out, r.predicted) for r in toxicity.score_toxicity(docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")), labels).collect()}
    toxic = [got[k][1] for k, y in lab.items() if k in got and got[k][0] and y == 1]
    fine = [got[k][1] for k, y in lab.items() if k in got and got[k][0] and y == 0]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(fine) <= 0.03 * len(fine)
    assert all(got[-1 - k][1] == 1 for k in range(len(own))) and got[-200][1] == 0
    assert sum(got[-100 - k][1] for k in range(len(own))) >= 0.6 * len(own)  # a doubled letter
