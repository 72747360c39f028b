"""The URL filter knows every word and token, however many there are."""

import itertools
import math

from pyspark.sql import functions as F

from meshwalk.llm import urls


def test_rare_tokens_have_weights(spark):
    """More distinct tokens than any fixed bound would keep; the rarest decide, smoothing counts all of them."""
    n = 60_000
    rows = spark.range(n).select("id", F.concat(F.lit("http://x.org/fr/a"), "id", F.lit("a/b"), "id", F.lit("b")).alias("url"), F.lit("").alias("html"))
    more = [(n + k, f"http://y.net/zz{k}", "") for k in range(3)] + [(n + 10, "http://z.test/zz1", ""), (n + 11, "http://z.test/a5a", ""), (n + 12, "http://z.test/none", "")]
    pages = rows.unionByName(spark.createDataFrame(more, "id long, url string, html string")).withColumnRenamed("id", "page_id")
    v, t_block, t_allow = 2 * n + 3 + 3, 6, 4 * n  # tokens: h:x, p:fr, a and b of each page; h:y, zz0 to zz2
    prior = math.log(3 / n)
    for limit in (1_000_000, 0):
        got = {r.page_id: r for r in urls.judge_urls(pages, broadcast_rows=limit).where(F.col("page_id") >= n).collect()}
        # the host piece z is unseen; z.test/zz1 has one known token that one page has
        assert abs(got[n + 10].score - (prior + math.log(2 / (t_block + v)) - math.log(1 / (t_allow + v)))) < 1e-9
        assert abs(got[n + 11].score - (prior + math.log(1 / (t_block + v)) - math.log(2 / (t_allow + v)))) < 1e-9
        assert got[n + 12].score == 0.0 and got[n + 12].verdict == "allow"


def test_hosts_are_split_by_rare_words(spark):
    """Two words behind 60,000 more frequent ones still split a host."""
    letters = "bcdfghklmnprstvwxz"
    common = ["q" + "".join(x) for x in itertools.islice(itertools.product(letters, repeat=4), 60_000)]
    html = [" ".join(common[k : k + 1000] * 2) for k in range(0, len(common), 1000)]
    rows = [(k, None, h) for k, h in enumerate(html)] + [(900, "http://umbrellaisland.test/x", "umbrella island")]
    counts = urls.word_counts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    names = spark.createDataFrame([("umbrellaisland",), ("42",), ("né",)], "name string")
    got = {r.name: r.words for r in urls.split_names(names, counts).collect()}
    assert got["umbrellaisland"] == ["umbrella", "island"] and got["42"] == ["#"]
    plain = urls.Splitter({r.w: r.n for r in counts.collect()})
    assert all(plain.split(x) == [x] if x == "42" else plain.split(x) == w for x, w in got.items())
