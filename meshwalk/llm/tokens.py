"""Byte-level BPE: exact token counts at every prefix, and ids, both through caches of space-free segments.

A text split at single spaces falls apart into segments that are encoded independently (each with the space before it),
because the pre-tokeniser's pieces hold white space only at their start. Texts with runs of white space around a space
are taken piece by piece instead.
"""

from __future__ import annotations

import json

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.llm.common import table
from meshwalk.llm.hashing import per_process, slices, text_slices

#: The byte-level pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 600_000  # entries a task keeps of each kind
LIMIT = 1024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def split_segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Offsets of the texts (null: empty) in their segments, the number of each segment, the distinct segments, and the
    texts that must not be split: those with other white space, or none, between two spaces or beside one."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    offsets -= offsets[0]
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary
    index, unique = coded.indices.to_numpy().copy(), words.to_numpy(zero_copy_only=False).tolist()
    empty = pc.equal(pc.binary_length(words), 0)
    edge = lambda trim: pc.or_(empty, pc.not_equal(trim(words), words)).to_numpy(zero_copy_only=False)
    left, right = edge(pc.utf8_ltrim_whitespace)[index], edge(pc.utf8_rtrim_whitespace)[index]
    bad = np.concatenate([[0], np.cumsum((left | right).astype(np.int64))])
    inner = bad[offsets[1:]] - bad[np.minimum(offsets[:-1] + 1, offsets[1:])]
    odd = np.flatnonzero((inner > 0) | (right[offsets[:-1]] & (np.diff(offsets) > 1)))
    return offsets, index, unique, odd


class PrefixCounter:
    """Token counts of every prefix of a piece by dynamic programming over the last token.

    The encoding of a prefix is that of a shorter one plus one token; a token may follow another exactly if the merges
    leave the two apart. So each prefix has one admissible last token, and its count is one more than that of the rest.
    """

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["special"]]
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        raw = {ord(chr(b)): chr(b) for b in shown} | {256 + k: chr(b) for k, b in enumerate(hidden)}
        # tokens as strings of bytes (one character each), numbered, in one automaton that finds all that end at a place
        vocab = {t.translate(raw): i for t, i in spec["model"]["vocab"].items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ranks = {(a.translate(raw), b.translate(raw)): r for r, (a, b) in enumerate(pairs)}
        self.tokens = {i: t for t, i in vocab.items()}
        self.ending = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.ending.add_word(t, (i, len(t)))
        self.ending.make_automaton()
        self.pairs: dict = {}
        self.pieces: dict = {}
        self.segments: dict = {}

    def merge(self, word: str) -> list[str]:
        parts, ranks = list(word), self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                r = ranks.get(pair)
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, key: int) -> bool:
        """Whether the merges leave the two tokens of ``key`` as they are (a first token of -1 is none)."""
        a, b = self.tokens.get((key >> 20) - 1, ""), self.tokens[key & 0xFFFFF]
        ok = self.pairs[key] = self.merge(a + b) == ([a, b] if a else [b])
        return ok

    def piece(self, text: str):
        """Counts after 0, 1, ... bytes of one pre-token."""
        known = self.pieces.get(text)
        if known is not None:
            return known
        pairs, apart = self.pairs, self._apart
        s = text.encode().decode("latin-1")
        count, last, done = [0] * (len(s) + 1), [-1] * (len(s) + 1), 0
        for end, (t, n) in self.ending.iter(s):
            if end < done:
                continue
            j = end + 1 - n
            key = last[j] + 1 << 20 | t
            ok = pairs.get(key)
            if ok or ok is None and apart(key):
                done = end + 1
                count[done], last[done] = count[j] + 1, t
        counts = bytes(count) if max(count) < 256 else count
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        if len(pairs) > 4 * CACHE:
            pairs.clear()
        self.pieces[text] = counts
        return counts

    def total(self, text: str) -> int:
        """Tokens of a text, over its pieces; special strings count one."""
        if self.split_special and any(x in text for x in self.special):
            return sum(1 if k % 2 else self.total(x) if x else 0 for k, x in enumerate(self.split_special.split(text)))
        return sum(self.piece(p)[-1] for p in self.pattern.findall(text))

    def by_segment(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of every text, and of its segments (what each adds to the prefix that ends with it) with the offsets of the
        texts in them."""
        offsets, index, unique, odd = split_segments(texts)
        got = np.array(self._resolve(unique), np.int64)
        counts, heads = got[index], offsets[:-1]
        counts[heads] = [self.total(unique[i]) if unique[i] else 0 for i in index[heads].tolist()]
        for k in odd.tolist():
            text = texts[k].as_py()
            counts[offsets[k] : offsets[k + 1]] = np.diff(self.segment_prefixes(text), prepend=0)
        return np.add.reduceat(counts, heads) if len(heads) else heads, counts, offsets

    def segment_prefixes(self, text: str) -> list[int]:
        """Tokens of the prefixes of a text that end before each space, and of all of it. White space that a prefix ends
        with is one piece, whatever follows it in the text; else the pieces up to there are the text's own."""
        if self.split_special and any(x in text for x in self.special):
            at = self.prefixes(text)
            return [int(at[k]) for k, c in enumerate(text) if c == " "] + [int(at[-1])]
        out, before, at = [], 0, 0
        run = (0, 0)  # where the latest stretch of white space begins, and the tokens before it
        for p in self.pattern.findall(text):
            counts, blank = self.piece(p), p.isspace()
            if not (blank and at and text[at - 1].isspace()):
                run = (at, before)
            if " " in p:
                if not blank and len(p) > 1:  # a space before a word: what stands before it counts as a whole
                    out.append(self._closed(text, at, run, before))
                else:
                    out += [self._closed(text, at + k, run, before) for k, c in enumerate(p) if c == " "]
            at, before = at + len(p), before + counts[-1]
        return [*out, before]

    def _closed(self, text: str, at: int, run: tuple[int, int], before: int) -> int:
        """Tokens of text[:at], where only the white space at its end can be cut otherwise than in the whole text."""
        begin, base = run
        return before if begin >= at or not text[begin:at].isspace() else base + self.total(text[begin:at])

    def _resolve(self, unique: list[str]) -> list[int]:
        """Tokens of " " + each segment."""
        known = self.segments
        got = list(map(known.get, unique))
        if None in got:
            for k, seg in enumerate(unique):
                if got[k] is None:
                    got[k] = known[seg] = self.total(" " + seg)
        if len(known) > CACHE:
            self.segments = dict(zip(unique, got, strict=True))
        return got

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to len(text), each as if that prefix were encoded by itself."""
        out, base, before = [0], 0, ""
        parts = self.split_special.split(text) if self.split_special else [text]
        for k, part in enumerate(parts):
            if k % 2:  # inside a special string the prefix ends in ordinary characters, after the piece before
                tail = before
                base_tail = base - (self.total(tail) if tail else 0)
                out += [base_tail + self.total(tail + part[:i]) for i in range(1, len(part))] + [base + 1]
                base, before = base + 1, ""
                continue
            pieces = self.pattern.findall(part)
            for n, p in enumerate(pieces):
                counts = self.piece(p)
                ends = np.cumsum([len(c.encode()) for c in p]).tolist()
                for i, e in enumerate(ends, 1):
                    c = base + counts[e]
                    if i < len(p) and p[0] == "'" and p[1:2].isalpha():  # a contraction cut short is a quote and letters
                        c = base + self.total(p[:i])
                    elif i == 1 and i < len(p) and n and p[0].isspace() and pieces[n - 1].isspace():  # the run of white space so far is one piece
                        c = base - self.piece(pieces[n - 1])[-1] + self.piece(pieces[n - 1] + p[0])[-1]
                    elif i == len(p) == 1 and n and p.isspace() and pieces[n - 1].isspace():
                        c = base - self.piece(pieces[n - 1])[-1] + self.piece(pieces[n - 1] + p)[-1]
                    out.append(c)
                base += counts[-1]
            before = pieces[-1] if pieces else ""
        return np.array(out, np.int64)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most ``budget`` tokens, from :meth:`PrefixCounter.prefixes`."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def cut_to_budget(text: str, word_counts: bytes, budget: int, counter: PrefixCounter) -> str:
    """The longest prefix of ``text``, by characters, of at most ``budget`` tokens. The stored counts say after which segment
    the budget is spent for good; characters are counted up to there alone, and nothing is encoded."""
    ends = np.cumsum(np.frombuffer(word_counts, "<i4"))
    if not len(ends) or ends[-1] <= budget:
        return text
    k = int(np.flatnonzero(ends <= budget)[-1]) if (ends <= budget).any() else -1
    near = " ".join(text.split(" ", k + 2)[: k + 2])
    return near[: longest_prefix(counter.prefixes(near), budget)]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens (long), word_counts (binary: int32 for each space-separated segment, what it adds: the
    tokens of the prefix that ends with a segment are the running sum, as if that prefix stood alone), fit_segments (long:
    segments of the longest such prefix of at most ``limit`` tokens). :func:`cut_to_budget` answers for any budget.

    Null and empty texts have 0 bytes and tokens. Texts of any length are counted whole. Rows are counted one by one: null
    ids, repeated rows and ties stay; an empty table gives an empty result; other columns are ignored.
    """
    path = path or default_path()

    def run(batches):
        counter = per_process(("prefix counter", path), lambda: PrefixCounter(path))
        for part in slices(batches):
            text = part.column(1)
            totals, counts, offsets = counter.by_segment(text)
            raw = pa.py_buffer(counts.astype("<i4").tobytes())
            words = pa.Array.from_buffers(pa.large_binary(), len(text), [None, pa.py_buffer((offsets * 4).astype(np.int64).tobytes()), raw])
            # running sums inside each text; the last one within the limit, as prefixes that end with white space may count less
            sums = np.cumsum(counts)
            sums -= np.repeat((sums - counts)[offsets[:-1]], np.diff(offsets))
            place = np.arange(len(counts)) - np.repeat(offsets[:-1], np.diff(offsets)) + 1
            fit = np.maximum.reduceat(np.where(sums <= limit, place, 0), offsets[:-1]) if len(text) else offsets[:0]
            yield pa.RecordBatch.from_arrays([
                part.column(0), pc.fill_null(pc.cast(pc.binary_length(text), pa.int64()), 0), pa.array(totals, pa.int64()), words.cast(pa.binary()), pa.array(fit, pa.int64()),
            ], ["doc_id", "n_bytes", "n_tokens", "word_counts", "fit_segments"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, word_counts binary, fit_segments long")


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts array<long>: the tokens of every prefix of the text, by characters; null texts: [0]."""
    path = path or default_path()

    def run(batches):
        counter = per_process(("prefix counter", path), lambda: PrefixCounter(path))
        for part, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([counter.prefixes((t or b"").decode()).tolist() for t in texts], pa.list_(pa.int64()))], ["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, counts array<long>")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    r = count_tokens(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_segments", "word_counts")
