"""Line-first quality rules: lines are judged and removed before the document is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwalk.llm.common import SPACES, grams, table, words

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A boilerplate phrase dominates a line with up to so many words for each of its phrases.
PHRASE_WORDS = 12
#: Lines that say nothing about the document they stand in.
BOILERPLATE = (
    r"(?i)(licen[sc]ed under|all rights reserved|\bcopyright\b|\(c\) \d{4}|terms of (use|service)|privacy policy"
    r"|\bcookies?\b|javascript|lorem ipsum|click here|subscribe to|spdx-license)"
)
NAVIGATION = r"(?i)^\s*(home|menu|login|log in|sign (in|up)|next|previous|back to top|share|search)\s*$"


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def bad_line(line: Column, phrase_words: int | None = PHRASE_WORDS) -> Column:
    """A line with words that fails a rule: punctuation (a fifth of its words carry doubled marks or symbol runs),
    navigation (a bar for every four words, or a lone menu word) or boilerplate (a known phrase for every
    ``phrase_words`` words; with None, one phrase in a line of any length)."""
    n = _count(line, WORD)
    shouting = _count(line, r"[!?]{2,}|[#*$%&<>~^=_]{2,}") * 5 >= n
    bars = _count(line, r"[|»>]") * 4 >= n
    boilerplate = line.rlike(BOILERPLATE)
    if phrase_words is not None:
        boilerplate = boilerplate & (_count(line, BOILERPLATE) * phrase_words >= n)  # few lines need the count
    return (n > 0) & (shouting | bars | line.rlike(NAVIGATION) | boilerplate)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                repeat_percent: int = 30, lost_percent: int = 50, keep: list[str] | None = None,
                phrase_words: int | None = PHRASE_WORDS) -> DataFrame:
    """Judge every line, drop the failing and the repeated ones, then judge the document.

    Returns ``id_col``, the columns of ``keep`` (as they are), ``clean_text`` and n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, n_kept_words (long), base_failed, kept (boolean). A document is kept unless
    base_failed or more than ``lost_percent`` of its words stand in removed lines.

    Null and empty texts have no words: base_failed, not kept, clean_text ''. Rows are judged one by one, so null
    ids, repeated rows and ties stay as they are; an empty table gives an empty result; further columns of ``docs``
    are ignored unless named in ``keep``, whatever their names. All in JVM expressions, without a shuffle.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep or [])], F.lit(0).alias("none")).alias("keep"), t.alias("text"))
    d = d.withColumn("w", words(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD)))
    w = F.col("w")
    d = d.withColumn("h", F.coalesce(grams(w, WINDOW, lambda x: F.xxhash64(*x)), F.array().cast("array<bigint>"))).withColumn("n_words", F.size("w").cast("long")).drop("w")
    d = d.withColumn("good", F.array_distinct(F.filter("lines", lambda x: ~bad_line(x, phrase_words))))
    h = F.col("h")
    # only texts in which some window comes back need their windows sorted
    d = d.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    s = F.col("s")
    twin = lambda i: F.coalesce(F.get(s, i)["x"] == F.get(s, i - 1)["x"], F.lit(False)) | F.coalesce(F.get(s, i)["x"] == F.get(s, i + 1)["x"], F.lit(False))
    d = d.withColumn("p", F.when(s.isNotNull(), F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), twin), lambda i: s[i]["i"]))))
    p = F.col("p")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, k: a + F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - F.get(p, k), F.lit(WINDOW))))
    text = F.col("text")
    # the floor of a random number below 1 is 0; as it is not deterministic, a filter on the result stays above these
    # expressions instead of being copied into them again and again
    barrier = F.floor(F.rand(0))
    d = d.select(
        "id", "keep", F.array_join("good", "\n").alias("clean_text"), (F.col("n_words") + barrier).cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(p.isNotNull(), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.coalesce(F.aggregate("good", F.lit(0), lambda a, x: a + _count(x, WORD)), F.lit(0)).cast("long").alias("n_kept_words"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return d.select(
        F.col("id").alias(id_col), *[F.col("keep")[f"k{i}"].alias(c) for i, c in enumerate(keep or [])], "clean_text",
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", failed.alias("base_failed"),
        (~failed & (100 * (F.col("n_words") - F.col("n_kept_words")) <= lost_percent * F.col("n_words"))).alias("kept"),
    )


def op4_line_quality(spark, sf_dir: str) -> DataFrame:
    # the SQL below fails a line of any length for one phrase, and so does the query; the pipeline does not
    return clean_lines(table(spark, sf_dir, "documents"), phrase_words=None).drop("clean_text")


#: The same figures in DuckDB; the patterns are the ones above.
OP4_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS w,
      list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, unnest(list_transform(range(0, len(w) - 7), lambda j: array_to_string(w[j + 1:j + 8], ' '))) AS win,
      unnest(range(0, len(w) - 7)) AS pos FROM (SELECT doc_id, w, row_number() OVER () AS i FROM a WHERE len(w) >= 8)),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
b AS (SELECT a.doc_id, len(w) AS n_words, text, lines, coalesce(rep.n, 0) AS n_repeat_words,
      list_distinct(list_filter(lines, lambda l: NOT (
        len(regexp_extract_all(l, '[!?]{{2,}}|[#*$%&<>~^=_]{{2,}}')) * 5 >= len(regexp_extract_all(l, '{WORD}'))
        OR len(regexp_extract_all(l, '[|»>]')) * 4 >= len(regexp_extract_all(l, '{WORD}'))
        OR regexp_matches(l, '{NAVIGATION}') OR regexp_matches(l, '{BOILERPLATE}')))) AS good
      FROM a LEFT JOIN rep USING (doc_id)),
c AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACES}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
      CAST(coalesce(list_sum(list_transform(good, lambda l: len(regexp_extract_all(l, '{WORD}')))), 0) AS BIGINT) AS n_kept_words FROM b)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * (n_words - n_kept_words) <= 50 * n_words AS kept FROM c
"""
