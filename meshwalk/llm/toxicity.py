"""Toxicity: a support vector machine over a subsequence string kernel with Nystroem landmarks."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.llm.common import table
from meshwalk.llm.hashing import per_process, text_slices

DECAY = 0.7
SPAN = 5  # characters that three matched ones may lie apart at most
OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
CODES = 32
SPACE = CODES**3
TRAIN_ROWS = 4000  # labelled texts of each label to learn from, at most
TRAIN_CHARS = 20_000  # longer texts are not learnt from
SHARPNESS = 6.0
SPEAKS = 15.0  # evidence (likelihood ratio) from which a window is learnt as toxic in every toxic text that holds it
LANDMARKS = 192
PAIRS = 32  # landmarks that are two words
CLEAN_WORDS = 10_000
HARD_WORDS = 2_500
ROUNDS = 5
THRESHOLD = 0.3
CACHE = 150_000

REPEATED = re.compile(r"(.)\1+")
_TABLE = np.zeros(0x110000, np.uint8)
for _c in range(0x110000):
    if (_s := chr(_c)).isalpha():
        _l = _s.lower()[0]
        _TABLE[_c] = ord(_l) - 96 if "a" <= _l <= "z" else 27 + ord(_l) % 5


def candidates(text: str) -> list[str]:
    """Words reduced to their letters, lower-cased; runs of three or more single letters are also read as one word."""
    out, run = [], []
    for token in text.split():
        w = token if token.isalpha() else "".join(filter(str.isalpha, token))
        if len(w) == 1 and len(token) <= 2:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run).lower())
        run = []
        if len(w) > 2:
            out.append(w.lower())
    if len(run) > 2:
        out.append("".join(run).lower())
    return out


def kernel_features(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gap-weighted triples of every word as (word number, triple, value), of norm 1: a triple counts DECAY to the power
    of the characters it spans, so that inserted characters lower a match without ending it. Both ends count as characters."""
    words = [REPEATED.sub(r"\1", w) for w in words]  # a doubled letter is read as one
    size = np.array([len(w) + 2 for w in words])
    flat = codes[np.frombuffer("".join([f" {w} " for w in words]).encode("utf-32-le"), np.uint32)].astype(np.int64)
    row = np.repeat(np.arange(len(words)), size)
    keys, values = [], []
    for a, b in OFFSETS:
        if len(flat) <= b:
            continue
        same = row[: len(row) - b] == row[b:]
        k = (row[:-b] * SPACE + (flat[:-b] * CODES + flat[a : len(flat) - b + a]) * CODES + flat[b:])[same]
        keys.append(k)
        values.append(np.full(len(k), DECAY ** (b - 2)))
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key, place = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(place, np.concatenate(values), len(key))
    row, triple = key // SPACE, key % SPACE
    norm = np.sqrt(np.bincount(row, value * value, len(words)))
    return row, triple, value / norm[row]


def _dense(words: list[str], codes: np.ndarray) -> np.ndarray:
    row, triple, value = kernel_features(words, codes)
    x = np.zeros((len(words), SPACE), np.float32)
    x[row, triple] = value
    return x


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps; the last weight is the bias."""
    w, blocks = np.zeros(x.shape[1] + 1), range(0, len(x), 2048)  # whole copies of x would fill the driver's memory
    for _ in range(steps):
        gram, right = penalty * weight.sum() * np.eye(len(w)), np.zeros(len(w))
        for k in blocks:
            part = np.hstack([x[k : k + 2048].astype(float), np.ones((len(x[k : k + 2048]), 1))])
            active = y[k : k + 2048] * (part @ w) < 1
            part, c = part[active], weight[k : k + 2048][active]
            gram += (part * c[:, None]).T @ part
            right += part.T @ (c * y[k : k + 2048][active])
        new = np.linalg.solve(gram, right)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def evidence(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Likelihood ratio of windows that stand in a of n1 toxic and b of n0 clean texts; 0 for what clean ones have more often."""
    share = (a + b) / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (np.where(a > 0, a * np.log(a / (n1 * share)), 0) + np.where(b > 0, b * np.log(b / (n0 * share)), 0))
    return np.where(a * n0 > b * n1, g, 0.0)


def _root(similar: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(similar)
    return vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T


def fit(texts: list[str], toxic: list[int], codes: np.ndarray = _TABLE) -> dict:
    """A support vector machine on labelled texts, each a bag of windows: its words and its pairs of neighbouring words.

    A text's value is that of its highest window. Clean texts want all windows under -1, toxic texts one over 1: the
    machine is trained on the best window of every toxic text, and those of its windows that speak for toxicity by
    themselves (``SPEAKS``; a text shares one vote among them), and windows of clean ones, then the best windows are chosen
    anew (multiple-instance learning). A clean window weighs less the more often toxic texts have it. A pair's kernel is the
    product of its words'. A logistic regression turns the highest value and the number of windows over 0 into a
    probability.

    What bounds the machine, whatever the texts: landmarks are chosen from the 400 words that speak most for toxicity and
    the 400 most frequent words of clean texts; the clean side begins with ``CLEAN_WORDS`` words (half of them the most
    frequent, half by a hash) and half as many pairs, and each round adds the ``HARD_WORDS`` highest of all other words and
    pairs of clean texts, so that none of them is out of its reach.
    """
    empty = {"count": 1, "words": 1, "starts": np.zeros(SPACE + 1, np.int32), "mark": np.empty(0, np.int16), "value": np.empty(0, np.float32), "weights": np.zeros(1), "bias": -1.0, "pairs": np.zeros(0, np.float32), "pair_bias": -1.0, "doc": (1.0, 0.0, -3.0)}
    texts, toxic = zip(*sorted(dict(zip(texts, toxic, strict=True)).items()), strict=True) if texts else ((), ())  # copies say nothing new
    y = np.array(toxic, bool)
    vocab: dict = {}
    ids = [np.array([vocab.setdefault(w, len(vocab)) for w in candidates(t or "")], np.int64) for t in texts]
    words, n1, n0 = list(vocab), int(y.sum()), int((~y).sum())
    size = len(words)
    if not n1 or not n0 or not size:
        return empty
    # windows: the distinct words of every text, then its distinct pairs, by number
    own = [np.unique(i) for i in ids]
    pair_of = [np.unique(i[:-1] * size + i[1:]) for i in ids]
    pair, place = np.unique(np.concatenate(pair_of), return_inverse=True)
    pair_own = np.split(place.astype(np.int32), np.cumsum([len(k) for k in pair_of])[:-1])
    del pair_of, place, ids
    left, right = pair // size, pair % size
    count = lambda rows, side, n: np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t == side]), minlength=n)
    a, b = count(own, True, size), count(own, False, size)
    pa_, pb_ = count(pair_own, True, len(pair)), count(pair_own, False, len(pair))
    g = evidence(a, b, n1, n0)
    gp = evidence(pa_, pb_, n1, n0)
    more = gp - np.maximum(g[left], g[right]) if len(pair) else gp  # what a pair says beyond its words
    gp = np.where(more > 0, gp, 0.0)
    # landmarks: the words that speak most for either side and are unlike those chosen already
    marks, chosen = [], np.zeros((0, SPACE), np.float32)
    toxic_first = sorted(np.flatnonzero(g > 0).tolist(), key=lambda k: (-g[k], words[k]))[:400]
    clean_first = sorted(np.flatnonzero(b > 0).tolist(), key=lambda k: (-b[k], words[k]))
    for pool, most in ((toxic_first, LANDMARKS * 2 // 3), (clean_first[:400], LANDMARKS)):
        for k, f in zip(pool, _dense([words[k] for k in pool], codes) if pool else (), strict=True):
            if len(marks) < most and f.any() and (not len(chosen) or (chosen @ f).max() < 0.8):
                marks.append(k)
                chosen = np.vstack([chosen, f])
    if not marks:
        return empty
    top = np.lexsort((pair, -more))[: PAIRS * 3 // 4]
    clean_pairs = np.lexsort((pair, -pb_))[:CLEAN_WORDS // 2]
    pair_marks = list(dict.fromkeys([*top[more[top] > 0].tolist(), *clean_pairs[: PAIRS // 4].tolist()]))
    m, n2 = len(marks), len(pair_marks)
    chosen = np.vstack([chosen, _dense([words[k] for k in [*left[pair_marks], *right[pair_marks]]], codes)]) if n2 else chosen
    model = {"count": len(chosen), "words": m, "weights": np.zeros(m), "bias": 0.0, "pairs": np.zeros(n2, np.float32), "pair_bias": -1.0, "doc": (0.0, 0.0, 0.0)}
    triple, mark = np.nonzero(chosen.T)  # by triple: the landmarks that hold it, and how
    model["starts"] = np.searchsorted(triple, np.arange(SPACE + 1)).astype(np.int32)
    model["mark"], model["value"] = mark.astype(np.int16), chosen.T[triple, mark].astype(np.float32)
    like = np.exp(SHARPNESS * (chosen @ chosen.T - 1))
    root, root2 = _root(like[:m, :m]), _root(like[m : m + n2, m : m + n2] * like[m + n2 :, m + n2 :]) if n2 else np.zeros((0, 0))
    del chosen
    first, second = np.zeros((size, n2), np.float32), np.zeros((size, n2), np.float32)
    for j in range(0, size, 2000):
        r = kernel_rows(words[j : j + 2000], model, codes)
        first[j : j + 2000], second[j : j + 2000] = r[:, m : m + n2], r[:, m + n2 :]
    rest = np.setdiff1d(np.flatnonzero(b > 0), clean_first[: CLEAN_WORDS // 2])
    rest = sorted(rest.tolist(), key=lambda k: (hash_of(words[k]), words[k]))[: CLEAN_WORDS // 2]
    clean_w = np.unique(np.array(clean_first[: CLEAN_WORDS // 2] + rest, np.int64))
    clean_p = clean_pairs[pb_[clean_pairs] > 0]
    value, value_p, seen = g, gp, None
    for _ in range(ROUNDS):
        best, vote = [], []
        for k in np.flatnonzero(y):
            w, q = own[k], pair_own[k]
            i, j = (int(w[np.argmax(value[w])]) if len(w) else -1), (int(q[np.argmax(value_p[q])]) if len(q) else -1)
            mine = {size + j if j >= 0 and value_p[j] > value[i] else i} if i >= 0 else set()
            mine |= set(w[g[w] > SPEAKS].tolist()) | set((size + q[gp[q] > SPEAKS]).tolist())
            best.extend(sorted(mine))
            vote.extend([1 / len(mine)] * len(mine) if mine else [])
        if best == seen:
            break
        seen = best
        win, place = np.unique(best, return_inverse=True)
        times = np.bincount(place, vote)
        up_w, up_p = win[win < size], win[win >= size] - size
        if not len(win) or not len(clean_w):
            return empty
        wk = np.concatenate([up_w, clean_w])
        pk = np.concatenate([up_p, clean_p]).astype(np.int64)
        x = np.zeros((len(wk) + len(pk), m + n2 + 1), np.float32)
        for j in range(0, len(wk), 2000):
            x[j : min(j + 2000, len(wk)), :m] = kernel_rows([words[k] for k in wk[j : j + 2000]], model, codes)[:, :m] @ root
        x[len(wk) :, m : m + n2] = (first[left[pk]] * second[right[pk]]) @ root2
        x[len(wk) :, -1] = 1
        sign = np.concatenate([np.ones(len(up_w)), -np.ones(len(clean_w)), np.ones(len(up_p)), -np.ones(len(clean_p))])
        weight = np.ones(len(x))
        weight[sign > 0] = times  # a toxic text, a vote
        # a window that toxic texts have far more often than clean ones says little as a clean one
        weight[len(up_w) : len(wk)] = b[clean_w] / n0 / (b[clean_w] / n0 + a[clean_w] / n1)
        weight[len(wk) + len(up_p) :] = pb_[clean_p] / n0 / (pb_[clean_p] / n0 + pa_[clean_p] / n1)
        for side in (1, -1):
            weight[sign == side] *= len(x) / (2 * weight[sign == side].sum())
        w = train_svm(x, sign, weight)
        model["weights"], model["bias"] = root @ w[:m], float(w[-1])
        model["pairs"], model["pair_bias"] = (root2 @ w[m : m + n2]).astype(np.float32), float(w[-1] + w[-2])
        value = np.concatenate([word_scores(words[j : j + 2000], model, codes) for j in range(0, size, 2000)])
        value_p = np.concatenate([(first[left[j : j + 50_000]] * second[right[j : j + 50_000]]) @ model["pairs"] for j in range(0, len(pair), 50_000)] or [np.empty(0)]) + model["pair_bias"]
        # windows of clean texts that come out too high join the clean side
        hard = lambda v, f: np.flatnonzero((v > -0.5) & (f > 0))
        h, hp = hard(value, b), hard(value_p, pb_)
        clean_w = np.union1d(clean_w, h[np.argsort(-value[h], kind="stable")[:HARD_WORDS]])
        clean_p = np.union1d(clean_p, hp[np.argsort(-value_p[hp], kind="stable")[:HARD_WORDS]])
    # from windows to texts: logistic regression on the two figures
    f = np.array([figures(np.concatenate([value[w], value_p[q]])) for w, q in zip(own, pair_own, strict=True)])
    x, t, c = np.hstack([f, np.ones((len(f), 1))]), y.astype(float), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-2 * np.eye(3)
        c = c + np.linalg.solve(h, x.T @ (t - p) - 1e-2 * c)
    model["doc"] = tuple(float(v) for v in c)
    return model


def figures(s: np.ndarray) -> tuple[float, float]:
    """The highest value of a text's distinct windows, and the logarithm of how many are over 0."""
    return (float(np.clip(s.max(), -3, 3)), math.log1p(int((s > 0).sum()))) if len(s) else (-3.0, 0.0)


def hash_of(w: str) -> int:
    import zlib

    return zlib.crc32(w.encode())


def kernel_rows(words: list[str], model: dict, codes: np.ndarray) -> np.ndarray:
    """exp(SHARPNESS * (similarity - 1)) of every word with every landmark; only shared triples cost anything."""
    row, triple, value = kernel_features(words, codes)
    n = model["starts"][triple + 1] - model["starts"][triple]
    hit = np.flatnonzero(n)
    n = n[hit]
    at = np.repeat(model["starts"][triple[hit]] - np.cumsum(n) + n, n) + np.arange(n.sum())
    m = model["count"]
    same = np.bincount(np.repeat(row[hit], n) * m + model["mark"][at], np.repeat(value[hit], n) * model["value"][at], len(words) * m)
    return np.exp(SHARPNESS * (same.reshape(len(words), m) - 1))


def word_scores(words: list[str], model: dict, codes: np.ndarray) -> np.ndarray:
    return kernel_rows(words, model, codes)[:, : model["words"]] @ model["weights"] + model["bias"]


def score_texts(docs: DataFrame, model: dict, codes: np.ndarray = _TABLE) -> DataFrame:
    """doc_id, score of every text from its words and pairs alone."""
    alpha = codes[:0x3000].copy()
    m, n2 = model["words"], len(model["pairs"])

    def run(batches):
        wide = per_process("letter codes", lambda: np.concatenate([alpha, np.array([27 + ord(chr(c).lower()[0]) % 5 if chr(c).isalpha() else 0 for c in range(len(alpha), 0x110000)], np.uint8)]))
        known: dict = {}
        value, first, second = np.empty(0), np.empty((0, n2), np.float32), np.empty((0, n2), np.float32)
        a, b, c = model["doc"]
        for part, texts in text_slices(batches, limit=4 << 20):
            split = [candidates((t or b"").decode()) for t in texts]
            if len(known) > CACHE:
                known.clear()
                value, first, second = value[:0], first[:0], second[:0]
            fresh = list({w for ws in split for w in ws if w not in known})
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            values, firsts, seconds = [value], [first], [second]
            for k in range(0, len(fresh), 5_000):
                r = kernel_rows(fresh[k : k + 5_000], model, wide)
                values.append(r[:, :m] @ model["weights"] + model["bias"])
                firsts.append(r[:, m : m + n2].astype(np.float32))
                seconds.append(r[:, m + n2 : m + 2 * n2].astype(np.float32))
            if fresh:
                value, first, second = np.concatenate(values), np.vstack(firsts), np.vstack(seconds)
            flat = np.fromiter((known[w] for ws in split for w in ws), np.int64)
            ends = np.cumsum([len(ws) for ws in split])
            pairs = [np.einsum("ij,ij,j->i", first[flat[k : min(k + 30_000, len(flat) - 1)]], second[flat[k + 1 : k + 30_001]], model["pairs"]) for k in range(0, len(flat) - 1, 30_000)]
            pairs = np.concatenate(pairs or [np.empty(0)]) + model["pair_bias"]
            out, start = [], 0
            for end in ends.tolist():
                i, s, p = flat[start:end], value[flat[start:end]], pairs[start : end - 1] if end > start else pairs[:0]
                top, n = -3.0, 0
                if end > start:
                    top = min(3.0, max(-3.0, float(s.max()), float(p.max()) if len(p) else -3.0))
                    n = len(set(i[s > 0].tolist())) + (len({(i[k], i[k + 1]) for k in np.flatnonzero(p > 0).tolist()}) if top > 0 else 0)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, a * top + b * math.log1p(n) + c)))))
                start = end
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """(text, toxic): the bounded sample to learn from. Up to ``rows`` labelled ids of each label outside the held-out fold,
    chosen by a hash of the id; of them those with a text of at most ``chars`` characters, one text an id, so that at most
    2 * rows * chars characters come together on the driver."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    lab = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold != 2).distinct()
    pick = lambda y: lab.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = F.broadcast(pick(1).unionAll(pick(0)))  # 2 * rows ids at most
    # rows that share an id stand for one text, the first of theirs
    return docs.where(F.length("text") <= chars).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> DataFrame:
    """doc_id, held_out, score, predicted for every text.

    Words are compared by triples of letters in order, close but not adjacent, pairs of neighbours by both their words;
    landmarks are words and pairs of the training texts; a linear SVM in the Nystroem map of the sharpened kernel, trained
    on the labels of texts by their highest windows (``fit``), becomes one weight a landmark.
    A text's score comes from its highest window and the number of windows over the margin. Learnt from at most ``rows``
    labelled texts of each label, of at most ``chars`` characters, whose crc32(doc_id) mod 4 is not 2; nothing but the text
    enters a score. Texts of any length are scored whole.

    Null and empty texts get the lowest score. Null ids are not held out; repeated rows are scored each and learnt from
    once; of equal training texts with different labels the larger label counts; without usable
    labels all scores are low; an empty table gives an empty result; other columns are ignored.
    """
    train = training_rows(docs, labels, rows, chars).toPandas()
    train = train.sort_values(["toxic", "text"])
    model = fit(train["text"].tolist(), train["toxic"].tolist())
    s = score_texts(docs, model)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
