"""All five stages in plain Python against the pipeline; odd tables through every stage."""

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as p
from meshwalk.llm import quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = re.compile(r"[!?]{2,}|[#*$%&<>~^=_]{2,}")


def words(t):
    return WORD.findall(t or "")


def clean(t):
    """The text without failing lines, or None where the document goes."""
    w, seen = words(t), {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    again = {i for at in seen.values() if len(at) > 1 for k in at for i in range(k, k + 8)}
    if len(w) < 20 or 100 * len(again) > 30 * len(w):
        return None
    good = []
    for line in t.split("\n"):
        n = len(words(line))
        phrases = len(re.findall(quality.BOILERPLATE, line))
        bad = len(BAD.findall(line)) * 5 >= n or len(re.findall(r"[|»>]", line)) * 4 >= n or re.search(quality.NAVIGATION, line) or (phrases and phrases * 12 >= n)
        if n and not bad and line not in good:
            good.append(line)
    kept = sum(len(words(x)) for x in good)
    return "\n".join(good) if 100 * (len(w) - kept) <= 50 * len(w) else None


def shingles(t):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def one_of_each(rows):
    s, low = {i: shingles(t) for i, t, *_ in rows}, {i: i for i, *_ in rows}
    for _ in rows:
        for i, a in s.items():
            for j, b in s.items():
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    low[i] = low[j] = min(low[i], low[j])
    return [r for r in rows if low[r[0]] == r[0]]


def corpus(items):
    r = random.Random(4)
    vocab = [f"w{k}" for k in range(900)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    base, rows = say(100).split(), []
    for i in range(70):
        kind = i % 7
        t = say(r.randint(25, 120))
        if kind == 1:
            b = list(base)
            b[r.randrange(100)] = "other"
            t = " ".join(b)
        elif kind == 2:
            t = f"{t}\nHome\n{say(10)}\nHome | Menu | Login | Search\nclick here for cookies\n{say(8)} "
        elif kind == 3:
            t = f"{say(12)} {items[i % len(items)]}\n{say(12)}"
        elif kind == 4:
            t = "again and again we say this " * 30 if i % 2 else say(5)
        elif kind == 5:
            t = "\n".join(["###!! $$$ %%%", say(30)] * 2 + [say(3)])
        rows.append((i, t, "en", [None, "a", "b", "c"][i % 4], len(t)))
    return [*rows, (70, None, None, None, None), (71, "", "en", "a", 0), (72, " ".join(base).upper(), "de", None, 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    items = [" ".join(f"q{r.randrange(500)}" for _ in range(n)) for n in (1, 4, 9, 30, 30, 60)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(corpus(items[2:]), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    return d, items, corpus(items[2:])


def test_every_stage_and_the_whole(spark, folder):
    from tokenizers import Tokenizer

    d, items, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    as_rows = lambda df: sorted(map(tuple, df.collect()))
    rows = [(i, c, lang, s, len(c)) for i, t, lang, s, _ in rows if (c := clean(t)) is not None]
    docs = p.quality(spark, docs, d)
    assert as_rows(docs) == sorted(rows) and 20 < len(rows) < 72
    before, rows = len(rows), one_of_each(rows)
    docs = p.near_duplicates(spark, docs, d)
    assert as_rows(docs) == sorted(rows) and len(rows) < before
    before, wanted = len(rows), [shingles(t) for t in items]
    rows = [x for x in rows if not any(100 * len(w & shingles(x[1])) >= 75 * len(w) for w in wanted)]
    docs = p.benchmark(spark, docs, d)
    assert as_rows(docs) == sorted(rows) and len(rows) < before
    mixed = as_rows(p.mixture(spark, docs, d))
    size = {x[0]: len(words(x[1])) for x in rows}
    assert set(mixed) <= set(rows)
    order = sorted({x[3] for x in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size[x[0]] for x in rows if x[3] == s) for s in order}
    target, free = {}, {s: k % 3 + 1 for k, s in enumerate(order)}
    while free:
        rest, weight = sum(total.values()) - sum(target.values()), sum(free.values())
        full = {s for s, w in free.items() if rest * w / weight > 3 * total[s]}
        target |= {s: 3 * total[s] if full else rest * free[s] / weight for s in full or free}
        free = {s: w for s, w in free.items() if s not in (full or free)}
    for s in order:
        assert abs(sum(size[x[0]] for x in mixed if x[3] == s) - target[s]) <= max(size[x[0]] for x in rows if x[3] == s)
    for x in rows:
        share = target[x[3]] / total[x[3]]
        assert int(share) <= mixed.count(x) <= int(share) + 1
    # the last stage, and run() itself, hold the ids of just these rows
    tok, want, at = Tokenizer.from_file(tokens.default_path()), [], 0
    for x in mixed:
        ids = np.array(tok.encode(x[1], add_special_tokens=False).ids + [2], "<u4")
        want.append((x[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, p.run(spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)


def test_empty_tables_nulls_and_long_texts(spark, folder):
    d, *_ = folder
    for rows in ([], [(None, None, None, None, None)] * 2, [(1, "word " * 200_000, "en", "a", 1), (1, None, "en", "a", 1), (None, "", None, None, None)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, f in p.STAGES:
            got = f(spark, docs, d)
            assert got.count() <= 3 * len(rows) and (name == "tokens" or got.columns == docs.columns)
            if name == "near_duplicates":
                assert got.count() == len(rows)
            if name == "tokens":
                assert got.count() == len(rows)
