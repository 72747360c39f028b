"""Boilerplate rules of the pipeline's quality stage."""

import corpus_pipeline

PHRASES = ["licensed under", "all rights reserved", "copyright", "(c) 2020", "terms of use", "terms of service", "privacy policy", "cookies", "cookie", "javascript", "lorem ipsum", "click here", "subscribe to", "SPDX-License"]


def test_long_clean_lines_may_mention_a_phrase(spark):
    before, after = " ".join(f"early{k}" for k in range(30)), " ".join(f"late{k}" for k in range(30))
    rows = [(k, f"{before} {x} {after}", "en", len(before)) for k, x in enumerate(PHRASES)]
    short = [f"This site uses {x}, as you know." for x in PHRASES]
    rows += [(100 + k, f"{before}\n{x}\n{after}", "en", 1) for k, x in enumerate(short)]
    rows += [(200, " ".join(f"click here {k} for cookies {k}" for k in range(12)), "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert all(got.get(i) == t for i, t, *_ in rows if i < 100)
    # a phrase still fails the short line that it dominates, and many phrases a long one
    assert all(got[100 + k] == f"{before}\n{after}" for k in range(len(short))) and 200 not in got
