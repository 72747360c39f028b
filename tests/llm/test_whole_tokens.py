"""Stored prefix counts against the library, and budgets answered from them."""

import random

import numpy as np

from meshwalk.llm import tokens

TEXTS = [
    "", " ", "  a", "a  b", "a \n b", "a\n b", "a \nb", "a\n\n b\n", "it's we're I'll '  x", "x<|endoftext|> y <|endoftext|>  z", "  a b  ", "a\x1cb \x1c c\x85 d", "a \u00a0 b\u00a0 c",
    "日本語 テキスト  😀 é", "\n\n\nfoo\n\n bar\t\tbaz ", "def f(x):\n    if x:\n        return  x  # two\n", "don' t", "one two three", "a" * 300 + " " + "b1c2" * 50 + "  end",
]


def texts():
    r = random.Random(5)
    return [*TEXTS, *["".join(r.choice(["a", "the", "n't", "'s", " ", " ", "  ", "\n", "\t", "7", "é", "!", "\u00a0"]) for _ in range(r.randint(1, 30))) for _ in range(300)], "word " * 30_000]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_running_sums_are_counts_of_prefixes(spark):
    tok = library()
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (999, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.count_tokens(docs, limit=6).collect()}
    assert got[999].fit_segments == 1 and got[999].n_tokens == 0
    for i, t in rows:
        sums = np.cumsum(np.frombuffer(got[i].word_counts, "<i4")).tolist()
        ends = [k for k, c in enumerate(t) if c == " "] + [len(t)]
        assert len(sums) == len(ends) and sums[-1] == got[i].n_tokens
        some = range(len(ends)) if len(ends) < 200 else (0, 7, 1000)
        assert [sums[k] for k in some] == [count(t[: ends[k]]) for k in some], t
        assert got[i].fit_segments == max([k + 1 for k, s in enumerate(sums) if s <= 6], default=0)


def test_budgets_are_answered_from_the_counts(spark):
    tok, counter = library(), tokens.PrefixCounter(tokens.default_path())
    rows = list(enumerate(texts()))[:120]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stored = {r.doc_id: r.word_counts for r in tokens.count_tokens(docs).collect()}
    for i, t in rows:
        every = [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        for budget in (0, 1, 3, 8):
            want = max(k for k, c in enumerate(every) if c <= budget)
            assert len(tokens.cut_to_budget(t, stored[i], budget, counter)) == want, (t, budget)
