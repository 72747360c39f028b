"""Content-addressed store of token ids: chunks once, recipes of documents, Merkle manifests."""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwalk.functions.shared import cut, discard, shared_dir
from meshwalk.llm.common import maybe_broadcast, table
from meshwalk.llm.hashing import ODD, mix64, per_process, slices
from meshwalk.llm.tokens import PATTERN, default_path, split_segments

END = 2
ROLL = 16  # ids in the rolling hash
MEAN_BITS, LEAST, MOST = 9, 128, 2048  # chunks of 512 ids on average
DIGEST = 16
LEAF, NODE = b"\x00", b"\x01"
SPACE = "\u0120"  # a space in the byte-level alphabet
CACHE = 20_000  # entries a task keeps of each kind and generation: most segments beyond the common ones never come again
SEEN = 300_000  # digests of chunks that a task remembers
FAN = 512  # nodes below one of a manifest's tree
TOP = 100  # chunks of most copies that are looked for
HOT = 100_000  # places at which one chunk stands, of which one task rebuilds documents
STRETCH = 1 << 15  # segments whose ids are gathered at a time, so that the places fit into a core's cache
GROUP = 300  # new segments split in one call
#: Letters of old alphabets, which every version of Unicode has as such: the pattern on texts of these, ASCII and line feeds is PLAIN.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u01bf\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0513\u05d0-\u05ea\u0621-\u063a\u0641-\u064a\u0905-\u0939\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
PLAIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[0-9]+| ?[^ \\n0-9{LETTERS}]+|\\n+(?!\\S)|\\n+")
KNOWN = f"^[\\n\\x21-\\x7e{LETTERS}]*$"
PART = "\udcff"  # stands for a byte that UTF-8 does not have


class Encoder:
    """Ids of whole texts, each distinct segment encoded by the library once (while it stays in the cache)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind, self.code = (np.dtype("<u2"), "H") if max(self.tok.get_vocab_size(), END + 1) <= 1 << 16 else (np.dtype("<u4"), "I")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PATTERN)
        # the same model without splitting
        self.whole, apart = Tokenizer.from_file(path), self.letters[0xFF]
        self.whole.pre_tokenizer = None
        self.part = self.tok.token_to_id(apart) if [t for t in self.tok.get_vocab() if apart in t] == [apart] else None
        # tokens that begin with a space: in joined segments each begins one
        self.spaced = np.zeros(max(self.tok.get_vocab().values()) + 1, bool)
        self.spaced[[i for t, i in self.tok.get_vocab().items() if t.startswith(SPACE)]] = True
        # two generations: what the older one has and nobody asks for again goes with it
        self.segments, self.older = {}, {}
        self.pieces: dict = {}

    def _piece(self, piece: str) -> bytes:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        plain = piece.isascii() and piece.isprintable()
        raw = piece.replace(" ", SPACE) if plain else piece.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.tok.model.tokenize(raw)]
        got = self.pieces[piece] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return got

    def _text(self, text: str) -> bytes:
        """Ids of a text that stands alone: the library's, with its own splitting where special strings occur."""
        if any(s in text for s in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        return b"".join([self.pieces.get(p) or self._piece(p) for p in self.pattern.findall(text)])

    def _plain(self, text: str) -> np.ndarray:
        """Ids of a text of KNOWN characters and spaces: its pieces, written as bytes, go to the library in one word. They are
        held apart by a byte that stands in no other token, so that no merge crosses it."""
        pieces = PLAIN.findall(text)
        if text.isascii():
            raw = self.letters[0xFF].join(pieces).replace(" ", SPACE).replace("\n", self.letters[10])
        else:
            raw = PART.join(pieces).encode("utf-8", "surrogateescape").decode("latin-1").translate(self.letters)
        ids = np.array(self.whole.encode_batch_fast([raw], add_special_tokens=False)[0].ids, self.kind)
        return ids[ids != self.part]

    def _group(self, group: list[str], known: bool) -> list[bytes]:
        """Ids of each segment with a space before it, split together: they are parted where a token begins with one."""
        text = " " + " ".join(group)
        if not any(s in text for s in self.special):
            ids = self._plain(text) if known else np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            cuts = np.flatnonzero(self.spaced[ids])
            if len(cuts) == len(group):
                raw, cuts = ids.tobytes(), (cuts * self.kind.itemsize).tolist()
                return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]
        return [self._text(" " + s) for s in group]

    def _encode(self, segments: list[str]) -> list[bytes]:
        # segments with white space at an end stand only in texts that are encoded whole, or at an end of one
        col = pa.array(segments, pa.large_string())
        single = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(col), col), pc.equal(pc.binary_length(col), 0)).to_numpy(zero_copy_only=False)
        known = pc.match_substring_regex(col, KNOWN).to_numpy(zero_copy_only=False) & (self.part is not None)
        made: list = [None] * len(segments)
        for k in np.flatnonzero(single).tolist():
            made[k] = self._text(" " + segments[k])
        kind = np.where(single, -1, known.astype(np.int8) + (known & pc.string_is_ascii(col).to_numpy(zero_copy_only=False)))
        for k in (0, 1, 2):  # other, known and ASCII ones, each in groups of their own
            at, mine = np.flatnonzero(kind == k).tolist(), k > 0
            for a in range(0, len(at), GROUP):
                group = at[a : a + GROUP]
                for i, x in zip(group, self._group([segments[i] for i in group], mine), strict=True):
                    made[i] = x
        return made

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by END, in one array, and the texts' offsets in it."""
        offsets, index, unique, odd = split_segments(texts)
        known = self.segments
        got = list(map(known.get, unique))
        if None in got:
            missing = [k for k, g in enumerate(got) if g is None]
            names = [unique[k] for k in missing]
            made = list(map(self.older.get, names))
            new = [k for k, g in enumerate(made) if g is None]
            for k, g in zip(new, self._encode([names[k] for k in new]), strict=True):
                made[k] = g
            known.update(zip(names, made, strict=True))
            for k, g in zip(missing, made, strict=True):
                got[k] = g
        if len(known) > CACHE:
            self.segments, self.older = {}, known
        whole = set(odd.tolist())
        # a first segment has no space before it; odd texts stand whole in place of theirs
        own = [self._text(texts[k].as_py() if k in whole else unique[i]) for k, i in enumerate(index[offsets[:-1]].tolist())]
        n = len(unique)
        index[offsets[:-1]] = n + np.arange(len(own))
        index = np.insert(index, offsets[1:], n + len(own))
        offsets = offsets + np.arange(len(offsets))
        for k in odd.tolist():
            index[offsets[k] + 1 : offsets[k + 1] - 1] = n + len(own) + 1  # nothing
        table = [*got, *own, np.array([END], self.kind).tobytes(), b""]
        size = np.fromiter(map(len, table), np.int32, len(table)) // np.int32(self.kind.itemsize)
        begin, flat = np.cumsum(size, dtype=np.int64) - size, np.frombuffer(b"".join(table), self.kind)
        length = size[index]
        ends, parts = np.concatenate([[0], np.cumsum(length, dtype=np.int64)]), []
        for a in range(0, len(index), STRETCH):
            b = min(a + STRETCH, len(index))
            at = np.repeat(begin[index[a:b]] - (ends[a:b] - ends[a]), length[a:b])
            at += np.arange(len(at))
            parts.append(flat[at])
        return np.concatenate(parts) if parts else np.empty(0, self.kind), ends[offsets]


def marks(ids: np.ndarray) -> np.ndarray:
    """Ends of the windows of ROLL ids whose rolling hash begins with MEAN_BITS zeros."""
    if len(ids) < ROLL:
        return np.empty(0, np.int64)
    h, base, width = mix64(ids.astype(np.uint64) + np.uint64(ODD)), ODD, 1
    while width < ROLL:  # of windows of twice the width, by Horner's rule
        h = h[:-width] * np.uint64(base) + h[width:]
        base, width = base * base % (1 << 64), 2 * width
    return np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + ROLL


def chunk_ends(n: int, found: list[int]) -> list[int]:
    """Content-defined ends of n ids with the given marks, LEAST to MOST ids apart."""
    ends, at = [], 0
    for m in found if n > LEAST else []:
        while m - at > MOST:
            at += MOST
            ends.append(at)
        if m - at >= LEAST:
            ends.append(m)
            at = m
    while n - at > MOST:
        at += MOST
        ends.append(at)
    return ends if at == n else [*ends, n]


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(LEAF + payload, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; a last odd node goes up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        pairs = [hashlib.blake2b(NODE + a + b, digest_size=DIGEST).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def _shift(crc: int, power: int) -> int:
    """Product of two polynomials modulo that of CRC-32 (bits reversed)."""
    out, m = 0, 1 << 31
    while m:
        if crc & m:
            out ^= power
        m >>= 1
        power = power >> 1 ^ 0xEDB88320 if power & 1 else power >> 1
    return out


def crc_after(n_bytes: int) -> int:
    """The factor by which n bytes after it change a CRC: x to the power 8n."""
    p, out, k = 1 << 30, 1 << 31, n_bytes * 8
    while k:
        if k & 1:
            out = _shift(out, p)
        p, k = _shift(p, p), k >> 1
    return out


RECIPES = "doc_id long, n_tokens long, chunks array<binary>, root binary, part int, local_start long, local_row long"
MANIFEST = "part int, start long, documents long, tokens long, root string"
STAGED = "doc_id long, n_tokens long, chunks array<binary>, root binary, digest binary, n int, payload binary, row long"


def _stage(path: str):
    """One pass over the texts: a recipe of each, and each chunk that this task meets first, with a number of its own."""

    def run(batches):
        coder = per_process(("encoder", path), lambda: Encoder(path))
        width = coder.kind.itemsize
        seen, row = set(), TaskContext.get().partitionId() << 40
        for part in slices(batches):
            recipes, chunks = [], []
            ids, offsets = coder.batch(part.column(1))
            found = marks(ids)
            lows, highs = np.searchsorted(found, offsets[:-1] + ROLL).tolist(), np.searchsorted(found, offsets[1:], "right").tolist()
            for lo, hi, low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lows, highs, strict=True):
                b, at, digests = ids[lo:hi].tobytes(), 0, []
                for e in chunk_ends(hi - lo, (found[low:high] - lo).tolist()):
                    d = address(b[at * width : e * width])
                    digests.append(d)
                    if d not in seen:
                        if len(seen) > SEEN:
                            seen.clear()
                        seen.add(d)
                        chunks.append((d, e - at, planes(b[at * width : e * width], width), row))
                        row += 1
                    at = e
                recipes.append((hi - lo, digests, merkle_root(digests)))
            a, z = len(recipes), len(chunks)
            n, digests, roots = zip(*recipes, strict=True)
            d, size, payload, rows = list(zip(*chunks, strict=True)) or [()] * 4
            cols = [part.column(0).to_pylist() + [None] * z, [*n, *[None] * z], [*digests, *[None] * z], [*roots, *[None] * z], [*[None] * a, *d], [*[None] * a, *size], [*[None] * a, *payload], [*[None] * a, *rows]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split(" ")[0] for x in STAGED.split(", ")])

    return run


def planes(raw: bytes, width: int) -> bytes:
    """Low bytes of all ids, then the next: the file compresses them better apart."""
    return np.frombuffer(raw, np.uint8).reshape(-1, width).T.tobytes()


def unplanes(raw: bytes, width: int) -> bytes:
    return np.frombuffer(raw, np.uint8).reshape(width, -1).T.tobytes()


def _number(batches):
    """Running start and number inside one sorted part."""
    at = row = 0
    for b in batches:
        n = b.column(b.schema.get_field_index("n_tokens")).to_numpy()
        starts, rows = at + np.cumsum(n) - n, np.arange(row, row + len(n))
        at, row = at + int(n.sum()), row + len(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64()), pa.array(rows, pa.int64())], [*b.schema.names, "local_start", "local_row"])


def merkle_parts(recipes: DataFrame) -> DataFrame:
    """(part, documents, tokens, root) of the recipes' parts. root is that of a Merkle tree over the documents' roots in
    order, each node over FAN nodes below it, built level by level: no group has more than FAN members."""
    node = F.unhex(F.sha2(F.concat(F.lit(NODE), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "root"))), lambda x: F.hex(x["root"])), "").cast("binary")), 256))
    own = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("n_tokens").cast("string")).cast("binary")
    t = recipes.select("part", F.col("local_row").alias("at"), F.unhex(F.sha2(F.concat(F.lit(LEAF), F.col("root"), own), 256)).alias("root"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"))
    most = recipes.agg(F.max("local_row")).first()[0]
    while most is not None:
        t = t.groupBy("part", F.floor(F.col("at") / FAN).alias("up")).agg(node.alias("root"), F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).withColumnRenamed("up", "at")
        if most < FAN:
            break
        most //= FAN
    return t.select("part", "documents", "tokens", F.lower(F.hex("root")).alias("root"))


def check_manifest(spark, folder: str) -> None:
    """Compares every part of the manifest with the recipes that are there; raises if one lacks, or differs in documents,
    tokens or root."""
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    r = merkle_parts(spark.read.schema(RECIPES).parquet(f"{folder}/recipes")).select(F.col("part").alias("p"), F.struct("documents", "tokens", "root").alias("got"))
    bad = m.withColumn("want", F.struct("documents", "tokens", "root")).join(r, F.col("part") == F.col("p"), "full").where(~F.col("want").eqNullSafe(F.col("got")))
    bad = sorted(x[0] for x in bad.select(F.coalesce("part", "p")).limit(10).collect())
    if bad:
        raise ValueError(f"parts {bad} of {folder} do not fit its manifest")


def write_store(docs: DataFrame, folder: str, path: str | None = None, parts: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write ``folder``/chunks, /recipes and /manifest.

    chunks: digest (BLAKE2b of the ids' bytes), n, payload (ids, low bytes first; the column is compressed), each digest once. recipes: the documents in
    ascending doc_id order (null first, repeated ids by their content), part by part: doc_id, n_tokens, chunks (digests
    in order), root (Merkle root of these), local_start, local_row, part. manifest: one row a part: part, start of its
    first document, documents, tokens, root of the tree over its documents (:func:`merkle_parts`).
    """
    path, docs = path or default_path(), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, staging = docs.sparkSession, f"{shared_dir(docs.sparkSession)}/staged"
    docs.mapInArrow(_stage(path), STAGED).write.option("compression", "none").mode("overwrite").parquet(staging)
    staged = spark.read.schema(STAGED).parquet(staging)
    # of equal chunks that several tasks have met, all rows but the first go; payloads are shuffled only if those are many
    chunks = staged.where("digest is not null")
    first = chunks.groupBy("digest").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last")
    extra = cut(chunks.select("digest", "row").join(first, "digest").where("row > first").select("row"), "extra")
    chunks.join(maybe_broadcast(extra), "row", "left_anti").select("digest", "n", "payload").write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/chunks")
    r = cut(staged.where("digest is null").select("doc_id", "n_tokens", "chunks", "root"), "recipes")
    discard(spark, staging)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = r.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "root").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
    r = r.withColumn("part", F.spark_partition_id())
    r.mapInArrow(_number, RECIPES).write.mode("overwrite").parquet(f"{folder}/recipes")
    m = merkle_parts(spark.read.schema(RECIPES).parquet(f"{folder}/recipes")).collect()  # one row a part
    rows, at = [], 0
    for x in sorted(m, key=lambda x: x["part"]):
        rows.append((x["part"], at, x["documents"], x["tokens"], x["root"]))
        at += x["tokens"]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")


def _verified(crc_only: bool):
    """Chunks whose content fits their address, else an error: digest, n and the CRC-32 of the ids as uint32 or the ids."""

    def run(batches):
        for b in batches:
            digests, ns, out = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for d, n, z in zip(digests, ns, b.column(2).to_pylist(), strict=True):
                raw = unplanes(z, len(z) // n) if len(z) % n == 0 else z
                if address(raw) != d:
                    raise ValueError(f"chunk {d.hex()} is damaged")
                wide = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                out.append(zlib.crc32(wide.tobytes()) if crc_only else wide.tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.int64() if crc_only else pa.list_(pa.int64()))], ["digest", "n", "value"])

    return run


def _parts(spark, folder: str, crc_only: bool, most: int) -> DataFrame:
    """doc_id, start, n_tokens, root and got: (seq, digest, n, value) of each chunk in order."""
    chunks = spark.read.parquet(f"{folder}/chunks").select("digest", "n", "payload")
    chunks = chunks.mapInArrow(_verified(crc_only), f"digest binary, n int, value {'long' if crc_only else 'array<long>'}")
    m = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("part", F.col("start").alias("base"))
    r = spark.read.schema(RECIPES).parquet(f"{folder}/recipes")
    # a chunk of very many copies is dealt to several tasks; a sketch of the most frequent ones says which
    top = r.select(F.explode("chunks").alias("digest")).agg(F.expr(f"approx_top_k(xxhash64(digest), {TOP}, {TOP * 100})").alias("top")).first()["top"]
    top = [(x["item"], -(-x["count"] // most)) for x in top or [] if x["count"] > most]
    r = r.join(F.broadcast(m), "part")  # one row a part
    r = r.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "root", F.posexplode("chunks").alias("seq", "digest"))
    if top:
        h = F.xxhash64("digest")
        salts = F.coalesce(*[F.when(h == k, F.lit(n)) for k, n in top], F.lit(1))
        r = r.withColumn("salt", F.pmod(F.xxhash64("start"), salts).cast("int"))
        chunks = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    r = r.join(chunks, ["digest", "salt"] if top else ["digest"], "left")
    # a document's start is its own: every document has its end id at least
    return r.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"),
                                  F.sort_array(F.collect_list(F.struct("seq", "digest", "n", "value"))).alias("got"))


def _documents(batch: pa.RecordBatch):
    """(digests, sizes, values) of each document of a batch of :func:`_parts`, checked against its root and length."""
    got = batch.column(batch.schema.get_field_index("got"))
    ends = (np.asarray(got.offsets) - got.offsets[0].as_py()).tolist()
    flat = got.flatten()
    digests, ns, values = (flat.field(k).to_pylist() for k in ("digest", "n", "value"))
    starts, totals, roots = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("start", "n_tokens", "root"))
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        d, n, v = digests[a:b], ns[a:b], values[a:b]
        if None in v or (merkle_root(d) if b - a != 1 else d[0]) != roots[k] or sum(n) != totals[k]:
            raise ValueError(f"document at {starts[k]} can't be rebuilt from its recipe")
        yield n, v


def _read(spark, folder: str, crc_only: bool, hot: int, name: str, kind: str, make) -> DataFrame:
    def run(batches):
        for b in batches:
            own = [b.column(b.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*own, pa.array([make(n, v) for n, v in _documents(b)], pa.int64() if crc_only else pa.list_(pa.int64()))], ["doc_id", "start", "n_tokens", name])

    check_manifest(spark, folder)
    return _parts(spark, folder, crc_only, hot).mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {kind}")


def read_ids(spark, folder: str, hot: int = HOT) -> DataFrame:
    """doc_id, start, n_tokens, ids: every document rebuilt from its recipe and checked against its Merkle root, after the
    recipes have been checked against the manifest."""
    return _read(spark, folder, False, hot, "ids", "array<long>", lambda n, v: [i for x in v for i in x])


def read_digests(spark, folder: str, hot: int = HOT) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone. Each stored chunk is read, inflated and checked once; a
    document's CRC is that of its chunks put together, so that no ids are shuffled. The recipes are checked against the
    manifest first."""
    factor: dict = {}

    def crc(n: list[int], v: list[int]) -> int:
        out = v[0]
        for size, value in zip(n[1:], v[1:], strict=True):
            if size not in factor:
                factor[size] = crc_after(4 * size)
            out = _shift(out, factor[size]) ^ value
        return out

    return _read(spark, folder, True, hot, "ids_crc32", "long", crc)


def store_tokens(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the store (in the shared folder unless ``folder`` is named) and return :func:`read_digests` of it.

    Null and empty texts are the end id alone; null doc_ids come first; repeated rows are written, and numbered, each;
    an empty table gives an empty store and result; other columns are ignored.
    """
    spark, folder = docs.sparkSession, folder or f"{shared_dir(docs.sparkSession)}/tokens"
    write_store(docs, folder, path)
    return read_digests(spark, folder)


def op8_token_store(spark, sf_dir: str) -> DataFrame:
    return store_tokens(table(spark, sf_dir, "documents"))
