"""URL filter: path rules, then host word segmentation (unigram Viterbi) and multinomial naive Bayes."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut
from meshwalk.llm.common import BROADCAST_ROWS, lower_ascii, maybe_broadcast, table

#: Verdict, host, path: a rule holds for its host and all below it, where the path begins with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LONGEST = 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return lower_ascii(part(1)), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame) -> DataFrame:
    """(w, n) of every word (a-z, 2 to LONGEST letters) of the text of all pages."""
    text = F.lower(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", " "))
    w = pages.select(F.explode(F.split(text, "[^a-z]+")).alias("w")).where(F.length("w").between(2, LONGEST))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n"))


class Splitter:
    """The most probable split of a name into words: sum of log counts; what is unknown costs more by each letter.
    ``total`` is the count of all words where ``counts`` holds only those that stand in the name."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(total * 10)

    def split(self, name: str) -> list[str]:
        best = [(0.0, 0)]
        for i in range(1, len(name) + 1):
            options = [(best[j][0] + self.cost.get(name[j:i], self.unknown + 3.0 * (i - j)), j) for j in range(max(0, i - LONGEST), i)]
            best.append(min(options))
        out, i = [], len(name)
        while i:
            out.append(name[best[i][1] : i])
            i = best[i][1]
        return out[::-1]


def path_tokens(path: str) -> list[str]:
    """Words of the path; numbers are one token."""
    out, word = [], ""
    for c in path.lower() + "/":
        if c.isalnum():
            word += c
        elif word:
            out.append("p:" + ("#" if word.isdigit() else word))
            word = ""
    return out


def split_names(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) of the distinct ``names``: pieces of the names meet the counts of all words in a join, so a name's
    split knows every word that stands in it, and no task holds the words of all pages."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    runs = F.regexp_extract_all("name", F.lit("([a-z]{2,})"))  # counted words have no other letters
    pieces = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.length(r), F.lit(LONGEST))), lambda k: F.transform(F.sequence(F.lit(1), F.length(r) - k + 1), lambda i: F.substring(r, i, k))))))
    found = names.select("name", F.explode(F.array_distinct(pieces)).alias("w")).join(counts, "w")
    found = found.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("found"))

    def split(batches):
        for b in batches:
            words = [["#" if w.isdigit() else w for w in Splitter(dict(m or ()), total).split(x)] for x, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["name", "words"])

    return names.join(found, "name", "left").select("name", "found").mapInArrow(split, "name string, words array<string>")


def host_tokens(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, host_tokens) of the distinct ``hosts``: words of their labels but the last (its zone says what the rules say)."""
    labels = F.split(F.split("host", ":")[0], r"\.")
    names = F.flatten(F.transform(F.slice(labels, F.lit(1), F.size(labels) - 1), lambda x: F.split(F.replace(x, F.lit("_"), F.lit("-")), F.lit("-"))))
    n = cut(hosts.select("host", F.posexplode(names).alias("k", "name")).where("name <> ''"), "names")
    j = n.join(split_names(n.select("name").distinct(), counts), "name")
    inner = lambda x: F.transform(x["words"], lambda w: F.concat(F.lit("h:"), w))
    return j.groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "words"))), inner)).alias("host_tokens"))


def rule_tokens(rules=RULES) -> list[str]:
    """Path tokens that the rules themselves are made of: they would only repeat what the rules say."""
    return sorted({t for _, _, p in rules for t in path_tokens(p)})


def judge_urls(pages: DataFrame, rules=RULES, broadcast_rows: int = BROADCAST_ROWS, rule_parts: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every page (url, html).

    The longest fitting rule decides. The rest is judged by multinomial naive Bayes over segmented host and path tokens
    (Laplace smoothing), learnt from the pages that rules decide; score is its log odds of block, and ties, pages without
    known tokens and tables without such pages or with one verdict alone are allowed by even odds (score 0).
    Every word and every token counts: their counts are tables, joined (tokens of hosts and weights are broadcast where
    they have at most ``broadcast_rows`` counted rows), and the driver sees sums alone. With ``rule_parts=False`` the path
    tokens that the rules are made of are no features, so that hosts and the other parts of paths decide.
    Words of more than LONGEST letters are not words to split by, in names of any length; very long urls and pages are
    one row's work.

    A null url, or one without "://", has empty host and path and no tokens. Rows are judged one by one: null ids and
    repeated rows stay; an empty table gives an empty result; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    d = d.withColumns({"rule": rule, "ruled": verdict})
    counts = cut(word_counts(pages), "words")
    hosts = cut(host_tokens(d.select("host").distinct(), counts), "hosts")

    left_out = set() if rule_parts else set(rule_tokens(rules))

    def paths(batches):
        for b in batches:
            tokens = [[t for t in path_tokens(p) if t not in left_out] for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], ["page_id", "host", "path", "rule", "ruled", "path_tokens"])

    d = d.mapInArrow(paths, "page_id long, host string, path string, rule string, ruled string, path_tokens array<string>")
    d = d.join(maybe_broadcast(hosts, limit=broadcast_rows), "host", "left")
    d = d.select("page_id", "host", "path", "rule", "ruled", F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), "path_tokens").alias("tokens"))
    d = cut(d.withColumn("row", F.monotonically_increasing_id()), "urls")
    labelled = d.where("ruled is not null")
    seen = labelled.groupBy("ruled").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("tokens")).alias("t")).collect()  # two rows
    seen = {r["ruled"]: (r["n"], r["t"]) for r in seen}
    fixed = [F.col(c) for c in ("page_id", "host", "path", "rule")]
    if len(seen) < 2:
        return d.select(*fixed, F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    t = labelled.select("ruled", F.explode("tokens").alias("w")).groupBy("w").agg(F.sum((F.col("ruled") == "block").cast("long")).alias("b"), F.count(F.lit(1)).alias("n"))
    t = cut(t, "tokens")
    v = t.count()
    log = lambda c, verdict: F.log((c + 1) / F.lit(float(seen[verdict][1] + v)))
    weights = t.select("w", (log(F.col("b"), "block") - log(F.col("n") - F.col("b"), "allow")).alias("weight"))
    s = d.select("row", F.posexplode("tokens").alias("k", "w")).join(maybe_broadcast(weights, v, broadcast_rows), "w")
    # added in the order of the tokens, so that a score does not depend on how rows travel
    s = s.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("k", "weight"))).alias("x"))
    s = s.select("row", (F.aggregate("x", F.lit(0.0), lambda a, x: a + x["weight"]) + math.log(seen["block"][0] / seen["allow"][0])).alias("s"))
    score = F.coalesce("s", F.lit(0.0))
    return d.join(s, "row", "left").select(*fixed, F.coalesce("ruled", F.when(score > 0, "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_parts=False)
