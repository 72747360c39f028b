"""The store's encoder on every kind of segment, against the library."""

import numpy as np
import pyarrow as pa
import pytest
from meshwalk.llm import tokenstore
from meshwalk.llm.tokens import default_path

SIGNS = ["a", "Ab", "it's", "we'll've", "don'T", "x_1", "12a", "éà", "При", "中文", "½", "١", "ÿ", "Ã¿", "é", "\U0001f600", "\n", "\n\n", ",", "...", "'", "Ġ", " ", " ", "\u0007", "<|endoftext|>", "\t"]


@pytest.fixture(scope="module")
def coder():
    return tokenstore.Encoder(default_path())


def test_every_mixture_of_characters_as_the_library(coder):
    g = np.random.default_rng(11)
    texts = ["", " ", None] + [" ".join("".join(SIGNS[k] for k in g.integers(0, len(SIGNS), n)) for n in g.integers(1, 5, 30)) for _ in range(300)]
    texts += [" ".join("".join(SIGNS[k] for k in g.integers(0, 15, n)) for n in g.integers(1, 7, 60)) for _ in range(100)]
    ids, offsets = coder.batch(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*coder.tok.encode(t or "", add_special_tokens=False).ids, tokenstore.END], t


def test_plain_segments_skip_the_library_s_splitting(coder, monkeypatch):
    asked = []

    class Splitting:
        def __getattr__(self, name):
            asked.append(name)
            return getattr(tok, name)

    tok = coder.tok
    monkeypatch.setattr(coder, "tok", Splitting())
    words = [f"zq{k}, {k}\nwx'll" for k in range(500)]
    coder.batch(pa.array([" ".join(words)]))
    assert "encode_batch_fast" not in asked
