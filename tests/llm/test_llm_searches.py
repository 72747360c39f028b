"""Personal data, ranked search and hard negatives against plain versions and on odd inputs."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from meshwalk.llm import hardneg, lexical, personal
from meshwalk.llm.common import table

SF = "/root/testdata/sf0.001"


# --- personal data
def _luhn(s):
    tot = 0
    for i, c in enumerate(reversed(s)):
        x = int(c)
        tot += (2 * x - 9 if x > 4 else 2 * x) if i % 2 else x
    return tot % 10 == 0


def _base(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append(("email", m.start(), m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 13 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


ODD = [
    None, "", "   ", "a@b.c_d@e.f 1.2.3.4.5.6.7.8 \x01 +49 (0) 30 1234567 x@y.z", "1.2.3.400 0001.002.255.0 1.2.3.", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111",
    "+1 (555) 123-4567 +1 +12345678 +123456789012345 +1234567890123456", "𝒳𝒳 é@x a.b@c.de é 10.0.0.1 ñ", "@@a@b..c a@b.c.d@e.f", "a@b " * 50 + "x@y.zz", "9" * 5000, "a.b" * 3000 + "@c.de", "1.1.1.1 " * 700,
    "4111 1111 1111 1111 +1 (555) 123-4567", "x\x01y@z.com\x01", "+1 (555) 123-4567 4111",
]


def test_base_spans_are_those_of_plain_patterns(spark):
    rng = np.random.default_rng(5)
    alphabet = list("a1.@+-( )é\x01 259") + ["4111 1111 1111 1111", "1.2.3.4", "b@c.de", "+49 30 123456", "4111-1111-1111-1111"]
    texts = ODD + ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(400)]
    docs = spark.createDataFrame([(k if k % 7 else None, t, "x", k) for k, t in enumerate(texts)], "doc_id int, text string, base string, n_email int")
    rows = personal.find_personal_data(docs).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for k, t in enumerate(texts):
        b = _base(t)
        n = Counter(x for x, _, _ in b)
        want[(k if k % 7 else None, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{x}:{s}:{e}" for x, s, e in b).encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in rows) == want
    for r in rows:  # base spans stay, further ones do not overlap them or one another
        if r.doc_id is not None:
            spans = [(x.split(":")[0], int(x.split(":")[1]), int(x.split(":")[2])) for x in r.spans.split(",") if x]
            base = _base(texts[r.doc_id])
            assert set(base) <= set(spans) and spans == sorted(spans, key=lambda x: (personal.KINDS.index(x[0]), x[1]))
            more = [x for x in spans if x not in base]
            assert all(a is b or a[1] >= b[2] or b[1] >= a[2] for a in more for b in [*base, *more])


def test_votes_add_spans_in_other_notations_and_leave_others(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    own = ["write to joe.doe [at] example [dot] com now", "call me on (555) 123-4567 today", "my iban DE89 3704 0044 0532 0130 00 is", "we met at noon dot matrix", "version 1.2.3.400 of order 4111 1111 1111 1112", "meet 10-12-2020 at 10 30 2000", "reach 2001:0db8:0000:0000:0000:0000:0000:0001 please"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - k, t) for k, t in enumerate(own)], "doc_id long, text string"))
    got = {-1 - r.doc_id: r.spans for r in personal.find_personal_data(docs).where("doc_id < 0").collect()}
    assert got[0] == "email:9:39" and got[1] == "phone:11:25" and got[2] == "iban:8:35"
    assert got[3] == got[4] == got[5] == ""


def test_weights_of_votes_follow_the_labelers():
    rng = np.random.default_rng(2)
    right = [0.95, 0.9, 0.85, 0.6, 0.7]
    seen = Counter()
    truth = rng.random(4000) < 0.3
    for y in truth:
        votes = tuple(int((1 if y else -1) * (1 if rng.random() < r else -1)) if rng.random() < 0.8 else 0 for r in right)
        seen[personal.CARD, votes] += 1
    m = personal.weigh_votes([(k, v, n) for (k, v), n in seen.items()])
    assert abs(1 / (1 + math.exp(-m["prior"][personal.CARD])) - 0.3) < 0.03
    strength = [w[1] - w[-1] for w in m["votes"]]
    assert strength == sorted(strength[:3], reverse=True) + [strength[3], strength[4]] and strength[3] < strength[4] < strength[2]
    assert abs(m["votes"][0][1] - math.log(0.95 / 0.05)) < 0.5
    assert personal.weigh_votes([])["prior"][0] == 0.0


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert personal.find_personal_data(docs).collect() == []
    assert lexical.rank_documents(docs, table(spark, SF, "benchmark")).collect() == []
    assert hardneg.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


# --- ranked search
def _ranked(docs, items, k=10):
    own = [(i, Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, length, df = len(own), sum(sum(c.values()) for _, c in own), Counter(t for _, c in own for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})))
    out = []
    for item, q in asked.items():
        s = []
        for i, c in own:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if score > 0:
                s.append((-score, i is not None, i, score))
        out += [(item, r + 1, i, score) for r, (_, _, i, score) in enumerate(sorted(s, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def test_ranking_equals_scores_of_all_documents(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(300)] + ["É", "É̃", "ñandú", "A", "a", "İ"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(k, " ".join(rng.choice(words, rng.integers(1, 120), p=p / p.sum()))) for k in range(600)]
    docs += [(7, docs[7][1]), (None, docs[7][1]), (9000, None), (9001, ""), (9002, "\t.,;"), (9003, "w1-w2_w3.W4|w5" * 3), (9004, "w0 " * 30_000)]
    docs += [(10_000 + k, docs[11][1]) for k in range(40)]
    items = [(k, " ".join(rng.choice(words, 12))) for k in range(25)] + [(3, "w299 w298"), (None, "w1 É"), (50, None), (51, "absent"), (52, "A a")]
    want = _ranked(docs, items)
    d = spark.createDataFrame([(*x, 1, "s") for x in docs], "doc_id int, text string, item_id int, rank string").repartition(3)
    i = spark.createDataFrame([(*x, 5) for x in items], "item_id int, text string, score int")
    assert sorted(map(tuple, lexical.rank_documents(d, i).collect()), key=str) == want
    monkeypatch.setattr(lexical, "DOCS", 16)  # many grids, several groups of items
    monkeypatch.setattr(lexical, "ITEMS", 7)
    assert sorted(map(tuple, lexical.rank_documents(d, i).collect()), key=str) == want


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 200, 300), (200, 3, 300), (64, 64, 4096), (100, 77, 2000)])
def test_treap_gives_the_best_columns(shape):
    r, c, n = shape
    rng = np.random.default_rng(r + c)
    cell = np.unique(rng.integers(0, r * c, n))
    rows, cols, value = cell // c, cell % c, rng.integers(1, 50, len(cell)).astype(np.int64)
    grid = np.zeros((r, c), np.int64)
    grid[rows, cols] = value
    weight = rng.integers(1, 9000, r)
    grid *= weight[:, None]
    masks, tops, by = lexical.build_treap(rows, cols, -(-value * weight[rows] // lexical.UNIT))
    ids = rng.permutation(c).astype(np.int64)
    t = lexical.Treap(masks, tops, value[by])
    for _ in range(10):
        q = np.unique(rng.integers(0, r, 6))
        s = grid[q].sum(axis=0)
        want = [(int(s[k]), int(k)) for k in np.lexsort((ids, -s))[:10] if s[k] > 0]
        assert sorted(t.search(q, weight[q], grid[q].max(axis=1), 1, ids)) == sorted(want)
        floor = int(np.median(s))
        assert sorted(t.search(q, weight[q], grid[q].max(axis=1), floor, ids)) == sorted(x for x in want if x[0] >= floor)


# --- hard negatives
def _negatives(rows):
    best: dict = {}
    for i, x, y in rows:
        if i is None or x is None or y is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = [math.floor(256 * float(c)) for c in x]
        y = (y + 1) % 10 if i % 7 == 0 else y
        if i not in best or (y, v) < best[i]:
            best[i] = (y, v)
    out = []
    for a, (ya, va) in best.items():
        if a % 100:
            continue
        s = sorted(((-sum(p * q for p, q in zip(va, v)), i, y) for i, (y, v) in best.items() if i != a))  # noqa: B905  shorter vectors go on with zeros
        for ps, pid, _ in [x for x in s if x[2] == ya][:5]:
            hit = [x for x in s if x[2] != ya and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(a, pid, r + 1, i, -ps, -ns) for r, (ns, i, _) in enumerate(hit)]
    return sorted(out)


def _vectors():
    rng = np.random.default_rng(9)
    mid = rng.normal(size=(12, 10))
    rows = [(k, (mid[k % 12] + 0.4 * rng.normal(size=10)).astype(np.float32).tolist(), int(k % 12 % 10)) for k in range(900)]
    rows += [(k, [0.5] * 10, k % 3) for k in range(1000, 1400)]  # one vector very often
    rows += [(1500, None, 1), (1600, [float("nan")] * 10, 1), (1700, [None] * 10, 2), (1800, [0.0] * 10, 2), (1900, [], 3), (2000, [0.25, -1.0, 3.0], 1), (None, [0.1] * 10, 1), (2100, [0.1] * 10, None), (2200, [float("inf")] * 10, 1)]
    rows += [rows[5], (5, rows[6][1], 4), (2300, [-2.0] * 10, 7), (2401, [1e9] * 10, 5), (2500, [1e8] * 10, 5)]
    return rows


def test_hard_negatives_equal_a_search_through_all_rows(spark, monkeypatch):
    rows = _vectors()
    d = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id int, embedding array<float>, label int, score double")
    want = _negatives([(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x], y) for i, x, y in rows])
    assert sorted(map(tuple, hardneg.hard_negatives(d).collect())) == want and len(want) > 100
    monkeypatch.setattr(hardneg, "CELL_ROWS", 16)  # many cells, several rounds, blocks and groups of visitors
    monkeypatch.setattr(hardneg, "FIRST", 20)
    monkeypatch.setattr(hardneg, "BLOCK", 8)
    monkeypatch.setattr(hardneg, "STRIPE", 2)
    monkeypatch.setattr(hardneg, "VISITORS", 3)
    assert sorted(map(tuple, hardneg.hard_negatives(d, sample=60).collect())) == want


def test_cells_come_by_falling_bounds_and_each_once():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 8)) * 50)
    ix = hardneg.Index([hardneg.fit_codebook(x[:, :4], 7), hardneg.fit_codebook(x[:, 4:], 7)], 4)
    near = [hardneg.nearest(h, b) for h, b in zip(ix.halves(x), ix.books, strict=True)]
    cell = near[0] * len(ix.books[1]) + near[1]
    r = [np.linalg.norm(h - b[m], axis=1) for h, b, m in zip(ix.halves(x), ix.books, near, strict=True)]
    ix.fill([(int(c), int((cell == c).sum()), r[0][cell == c].max(), r[1][cell == c].max()) for c in np.unique(cell)])
    q = x[3]
    cells, _, sure = ix.visits(q, 0, 10**9, -1e18, 1e18)
    assert sure and sorted(cells) == sorted(np.unique(cell).tolist())
    best = np.sort(x @ q)[-20]
    some, taken, sure = ix.visits(q, 0, 10**9, float(best), 1e18)
    assert sure and set(np.unique(cell[x @ q >= best])) <= set(some) and len(some) < len(cells)
    first, taken, sure = ix.visits(q, 0, 40, -1e18, 1e18)
    rest, _, _ = ix.visits(q, taken, 10**9, -1e18, 1e18)
    assert not sure and first + rest == cells
