"""Operator 1: content-addressed token store.

Texts become token ids; a rolling hash over ids cuts each document's stream into chunks; every distinct
chunk is stored once, keyed by its SHA-256; a recipe per document lists its chunks in order; Merkle roots
of documents, recipe blocks and the store verify what is read back.

Layout below one root: ``store/kind=1`` chunk table (key, payload), ``recipes`` (one row per document in
ascending doc_id order, in ordered blocks), ``manifest`` (one row per block, with the root of all blocks).
Payload: one format byte (2 or 4: bytes an id takes) and the zstd frame of the little-endian ids.

Defined cases: null and empty texts are streams of just the end id; documents with equal doc_id are kept
as rows of their own, ordered by content root; a null doc_id sorts first; extra columns are ignored; an
empty table gives an empty store. Special-token strings inside a text are ordinary text.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import mix64, new_path, pick, slices, small_batches, span_hashes, to_batch

#: Chunk sizes in ids; a cut falls where the low bits of the rolling hash of WINDOW ids are all zero.
MIN_CHUNK, MAX_CHUNK, MASK, WINDOW = 256, 4096, np.uint64(511), 16
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Words that a worker remembers, and how many new ones it gathers before it sorts them in.
MEMO, MERGE = 2_000_000, 100_000

_ROWS = T.StructType(
    [
        T.StructField("kind", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("digests", T.ArrayType(T.BinaryType())),
        T.StructField("tails", T.ArrayType(T.LongType())),
        T.StructField("root", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_ARROW_ROWS = pa.schema(
    [
        ("kind", pa.int32()),
        ("key", pa.binary()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("digests", pa.list_(pa.binary())),
        ("tails", pa.list_(pa.int64())),
        ("root", pa.binary()),
        ("payload", pa.binary()),
    ]
)


class WordTable:
    """Words by hash: sorted hashes, where each word's ids lie, and where its characters lie to compare with."""

    def __init__(self):
        self.columns = [np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int32, np.int64, np.int32)]

    def __len__(self):
        return len(self.columns[0])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, size, at, length) of each of the sorted ``keys``; first is -1 where there is none."""
        if not len(self):
            return np.full(len(keys), -1), *(np.zeros(len(keys), dtype=np.int64) for _ in range(3))
        at = np.minimum(np.searchsorted(self.columns[0], keys), len(self) - 1)
        hit = self.columns[0][at] == keys
        return np.where(hit, self.columns[1][at], -1), *(np.where(hit, c[at], 0).astype(np.int64) for c in self.columns[2:])

    def add(self, *columns: np.ndarray) -> None:
        """More words, sorted by key."""
        at = np.searchsorted(self.columns[0], columns[0])
        self.columns = [np.insert(old, at, new) for old, new in zip(self.columns, columns)]


def _flat(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All places of spans, one span after the other."""
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(start - ends + n, n)


class _Pool:
    """A growing array."""

    def __init__(self):
        self.values, self.n = np.zeros(1 << 16, dtype=np.uint32), 0

    def put(self, fresh: np.ndarray) -> None:
        """Write behind the end, without moving the end."""
        if self.n + len(fresh) > len(self.values):
            more = max(len(self.values) // 2, len(fresh))
            self.values = np.concatenate([self.values, np.zeros(more, dtype=np.uint32)])
        self.values[self.n : self.n + len(fresh)] = fresh


class WordEncoder:
    """Encodes texts with a `tokenizers` file, remembering the ids of words seen before.

    A byte-level pre-tokenizer never joins a character with a following space or line feed, and a single
    space or line feed between other characters always starts a new piece, so a text may be cut there and
    the parts encoded one by one with equal results. Texts with runs of white space, or with white space of
    other kinds, are encoded whole. Words that are new are encoded together, one a line, and their ids cut
    at the line feed's id. Words are looked up by hash, a batch of texts at a time, and compared character by
    character with the word remembered: where different words share a hash, the batch is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        lines = self.tokenizer.encode(" a\n b", add_special_tokens=False).ids
        alone = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in (" a", " b")]
        #: The id that cuts lines, if the vocabulary has one.
        self.feed = feed[0] if len(feed) == 1 and lines == [*alone[0], *feed, *alone[1]] else None
        self.main, self.recent = WordTable(), WordTable()
        self.ids, self.words = _Pool(), _Pool()

    def _bytes(self, texts: list[str]) -> list[bytes]:
        batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [array("I", x.ids).tobytes() for x in batch(texts, add_special_tokens=False)]

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of pieces; a mark in front of a piece stands for the start of a text."""
        out: list[bytes] = [b""] * len(words)
        spaced = [i for i, w in enumerate(words) if w[0] == " "] if self.feed is not None else []
        for at in range(0, len(spaced), 5_000):
            own = spaced[at : at + 5_000]
            raw = self._bytes(["\n".join([words[i] for i in own])])[0]
            ends = [*(4 * np.flatnonzero(np.frombuffer(raw, dtype=np.uint32) == self.feed)).tolist(), len(raw)]
            if len(ends) != len(own):
                raise ValueError("the tokenizer does not keep lines apart")
            for i, a, b in zip(own, [0, *[e + 4 for e in ends]], ends):
                out[i] = raw[a:b]
        rest = [i for i, w in enumerate(words) if w[0] != " " or self.feed is None]
        for i, raw in zip(rest, self._bytes([words[i].removeprefix(_MARK) for i in rest])):
            out[i] = raw
        return out

    def _learn(self, keys: np.ndarray, words: list[str], codes: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words (sorted by key; ``codes``: their characters, one word after the other)."""
        found = self._ids_of(words)
        size = np.asarray([len(x) // 4 for x in found], dtype=np.int64)
        fresh = np.frombuffer(b"".join(found), dtype=np.uint32)
        self.ids.put(fresh)
        first = self.ids.n + np.cumsum(size) - size
        if len(self.main) >= MEMO:
            # Full: these ids are of use until the next words overwrite them.
            return first, size
        self.words.put(codes)
        self.recent.add(keys, first, size, self.words.n + np.cumsum(length) - length, length)
        self.ids.n += len(fresh)
        self.words.n += len(codes)
        if len(self.recent) > MERGE:
            self.main.add(*self.recent.columns)
            self.recent = WordTable()
        return first, size

    def _encode_flat(self, flat: str) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids of all texts, number of ids of each); a mark stands before each text. None if two words share a hash."""
        codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        begins = codes == ord(_MARK)
        start = np.flatnonzero(begins | (codes == 32) | (codes == 10))
        end = np.append(start[1:], len(codes))
        n = end - start
        inverse, keys = pd.factorize(span_hashes(codes, start, end), sort=True)
        pick = np.empty(len(keys), dtype=np.int64)
        pick[inverse[::-1]] = np.arange(len(inverse))[::-1]
        if not (n[pick][inverse] == n).all() or not (codes[_flat(start[pick][inverse], n)] == codes).all():
            return None
        first, size, at, length = self.main.find(keys)
        more = np.flatnonzero(first < 0)
        first[more], size[more], at[more], length[more] = self.recent.find(keys[more])
        known = np.flatnonzero(first >= 0)
        where = pick[known]
        if not (n[where] == length[known]).all() or not (self.words.values[_flat(at[known], length[known])] == codes[_flat(start[where], n[where])]).all():
            return None
        more = np.flatnonzero(first < 0)
        if len(more):
            where = pick[more]
            words = [flat[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())]
            first[more], size[more] = self._learn(keys[more], words, codes[_flat(start[where], n[where])], n[where])
        first, size = first[inverse], size[inverse]
        return self.ids.values[_flat(first, size)], np.add.reduceat(size, np.flatnonzero(begins[start]))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        plain = [_plain(t) for t in texts]
        flat = "".join([_MARK + t for t, p in zip(texts, plain) if p])
        found = self._encode_flat(flat) if flat else None
        if found is None:
            return self._bytes([t or "" for t in texts])
        whole = iter(self._bytes([t or "" for t, p in zip(texts, plain) if not p]))
        ids, counts = found
        raw = ids.astype("<u4").tobytes()
        ends = np.cumsum(4 * counts).tolist()
        cut = iter([raw[a:b] for a, b in zip([0, *ends], ends)])
        return [next(cut) if p else next(whole) for p in plain]


_MARK = "\x01"


def _plain(text: str | None) -> bool:
    """Whether all white space of a text is single spaces and line feeds between other characters."""
    return (
        bool(text) and not text[0].isspace() and not text[-1].isspace() and "  " not in text and "\n\n" not in text and " \n" not in text and "\n " not in text
        and _MARK not in text and len(text.split()) == 1 + text.count(" ") + text.count("\n")
    )


@functools.lru_cache(maxsize=1)
def _encoder(path: str, run: str) -> WordEncoder:
    """The worker's encoder; ``run`` names the store being written: words are remembered across its tasks only."""
    return WordEncoder(path)


def rolling_hits(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids allows a cut.

    The streams of several documents may stand one after the other: a chunk has at least MIN_CHUNK ids, more
    than the window, so what lies before a document is never seen by its cuts.
    """
    with np.errstate(over="ignore"):
        h = mix64(ids.astype(np.uint64) + np.uint64(1))
        step, b = 1, _MULTIPLIER
        while step < WINDOW:
            h[step:] = h[step:] + np.uint64(b) * h[:-step]
            step, b = step * 2, b * b % 2**64
    return np.flatnonzero(((h >> np.uint64(20)) & MASK) == 0) + 1


def cut_points(n: int, hits: list[int]) -> list[int]:
    """Ends of the chunks of a stream of ``n`` ids, cut at ``hits``; they depend on nearby content only, so edits stay local."""
    ends, at = [], 0
    for c in hits:
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK:
            ends.append(c)
            at = c
    while n - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


class Merkle:
    """Binary Merkle root of leaves added one by one, in memory of the tree's height; leaves and inner nodes are hashed under different prefixes."""

    def __init__(self):
        self.peaks: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == height:
            height, node = height + 1, hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
        self.peaks.append((height, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        node = self.peaks[-1][1]
        for _, left in self.peaks[-2::-1]:
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


def merkle(leaves) -> bytes:
    tree = Merkle()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


def pack(ids: np.ndarray, compressor) -> bytes:
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return (b"\4" if wide else b"\2") + compressor.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def unpack(payload: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(payload[1:]), dtype="<u4" if payload[:1] == b"\4" else "<u2").astype("<u4")


def _encode(path: str, end_id: int, run_name: str):
    def run(batches):
        import zstandard

        encoder, compressor, seen = _encoder(path, run_name), zstandard.ZstdCompressor(level=1), set()
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for part in slices(batches, "text", rows=500, size=1_000_000):
            out = {f.name: [] for f in _ARROW_ROWS}
            streams = [raw + end for raw in encoder.encode(part.column("text").to_pylist())]
            every = np.frombuffer(b"".join(streams), dtype="<u4")
            hits, begin = rolling_hits(every), 0
            bounds = np.searchsorted(hits, np.cumsum([0, *(len(x) // 4 for x in streams)]), side="right").tolist()
            for doc_id, raw, first, last in zip(part.column("doc_id").to_pylist(), streams, bounds, bounds[1:]):
                n = len(raw) // 4
                ids, digests, tails, at = every[begin : begin + n], [], [], 0
                points = cut_points(n, (hits[first:last] - begin).tolist())
                begin += n
                for to in points:
                    digest = hashlib.sha256(raw[4 * at : 4 * to]).digest()
                    digests.append(digest)
                    tails.append(len(raw) - 4 * to)
                    if digest not in seen:
                        seen.add(digest)
                        for k, v in zip(out, (1, digest, None, None, None, None, None, pack(ids[at:to], compressor))):
                            out[k].append(v)
                    at = to
                root = merkle(digests)
                key = hashlib.sha256(b"%d" % (doc_id or 0) + root).digest()
                for k, v in zip(out, (0, key, doc_id, len(ids), digests, tails, root, None)):
                    out[k].append(v)
            yield to_batch(out, _ARROW_ROWS)

    return run


def _once(batches):
    """Rows come sorted by kind and key: of chunks with one key only the first stays."""
    last = None
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist()):
            keep.append(kind == 0 or key != last)
            last = key if kind else last
        yield batch.filter(pa.array(keep))


def _blocks(batches):
    """Running sums within an ordered block; the block's last row carries its Merkle root and sum."""
    total, tree, held = 0, Merkle(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held.append_column("block_root", pa.nulls(held.num_rows, pa.binary()))
        n = np.asarray(batch.column("n_tokens"))
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        for root in batch.column("root").to_pylist():
            tree.add(root)
        held = batch.append_column("before", pa.array(before, pa.int64()))
    if held is not None:
        yield held.append_column("block_root", pa.array([None] * (held.num_rows - 1) + [tree.root()], pa.binary()))


def write_store(documents: DataFrame, tokenizer_path: str, end_id: int = 2, root: str | None = None) -> str:
    """Encode ``documents`` (doc_id, text) into a store below ``root``; returns the root.

    One shuffle moves each distinct chunk of a task once (equal chunks are dropped before it); the recipes
    that are ordered by doc_id hold digests only.
    """
    spark = documents.sparkSession
    small_batches(spark)
    root = root or new_path(spark, "tokenstore")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.mapInArrow(_encode(tokenizer_path, end_id, root), _ROWS).repartition("key").sortWithinPartitions("kind", "key")
    rows.mapInArrow(_once, _ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{root}/store")
    recipes = _store(spark, root).filter("kind = 0").select("doc_id", "n_tokens", "digests", "tails", "root")
    recipes = recipes.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("block", F.spark_partition_id())
    kinds = T.StructType([*recipes.schema.fields, T.StructField("before", T.LongType()), T.StructField("block_root", T.BinaryType())])
    recipes.mapInArrow(_blocks, kinds).write.option("compression", "zstd").parquet(f"{root}/recipes")
    blocks = spark.read.schema(kinds).parquet(f"{root}/recipes").filter("block_root is not null")
    blocks = blocks.select("block", "block_root", (F.col("before") + F.col("n_tokens")).alias("n_ids"))
    # One row a block, so at most as many rows as there were partitions.
    offset = F.sum("n_ids").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("first", F.coalesce(offset, F.lit(0)).cast("long"))
    top = merkle([bytes(r.block_root) for r in blocks.orderBy("block").select("block_root").collect()])
    blocks.withColumn("store_root", F.lit(bytearray(top))).coalesce(1).write.parquet(f"{root}/manifest")
    return root


def _store(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(T.StructType([*_ROWS.fields[1:], _ROWS.fields[0]])).parquet(f"{root}/store")


def recipes_of(spark: SparkSession, root: str) -> DataFrame:
    """Recipes with ``start``: the ids of all documents before, in store order."""
    kinds = "doc_id long, n_tokens long, digests array<binary>, tails array<long>, root binary, block int, before long, block_root binary"
    manifest = spark.read.schema("block int, block_root binary, n_ids long, first long, store_root binary").parquet(f"{root}/manifest")
    recipes = spark.read.schema(kinds).parquet(f"{root}/recipes").drop("block_root")
    # The manifest has a row for each block, never more than partitions: small whatever the input.
    first = F.broadcast(manifest.select("block", "first"))
    return recipes.join(first, "block").withColumn("start", F.col("first") + F.col("before")).drop("first", "before")


def _expand(batches):
    """One row per chunk of a document, after checking the document's Merkle root."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digest", pa.binary()), ("tail", pa.int64())])
    for batch in batches:
        out = {f.name: [] for f in kinds}
        for doc_id, start, n, digests, tails, root in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "n_tokens", "digests", "tails", "root"))):
            if merkle(digests) != root:
                raise ValueError(f"recipe of document {doc_id} does not match its Merkle root")
            for digest, tail in zip(digests, tails):
                for k, v in zip(out, (doc_id, start, n, digest, tail)):
                    out[k].append(v)
        yield to_batch(out, kinds)


def _digest_chunks(batches):
    """CRC-32 of every stored chunk's ids, after checking its content against its address."""
    import zstandard

    reader, kinds = zstandard.ZstdDecompressor(), pa.schema([("digest", pa.binary()), ("crc", pa.int64())])
    for batch in batches:
        crcs = []
        for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist()):
            raw = unpack(payload, reader).tobytes()
            if hashlib.sha256(raw).digest() != key:
                raise ValueError("a stored chunk does not match its address")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64())], schema=kinds)


@functools.cache
def _crc_tables(bit: int) -> np.ndarray:
    """Look-up tables that append 2**bit zero bytes to a CRC-32, one for each byte of the register."""
    if bit == 0:
        crc = np.asarray([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\0") for i in range(256)], dtype=np.uint32)
        basis = [1 << k for k in range(32)]
        moved = [int(crc[x & 0xFF]) ^ (x >> 8) for x in basis]
    else:
        before = _crc_tables(bit - 1)
        once = lambda x: _apply(before, np.asarray([x], dtype=np.uint32))
        moved = [int(_apply(before, once(1 << k))[0]) for k in range(32)]
    out = np.zeros((4, 256), dtype=np.uint32)
    for byte in range(4):
        for value in range(256):
            for k in range(8):
                if value >> k & 1:
                    out[byte, value] ^= np.uint32(moved[8 * byte + k])
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 0xFF] ^ tables[1][x >> 8 & 0xFF] ^ tables[2][x >> 16 & 0xFF] ^ tables[3][x >> 24]


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """The part that a piece with this CRC-32 has in the CRC-32 of a stream going on for ``n_bytes`` more."""
    out, n_bytes = crc.astype(np.uint32), np.asarray(n_bytes, dtype=np.int64)
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        on = (n_bytes >> bit & 1).astype(bool)
        out[on] = _apply(_crc_tables(bit), out[on])
    return out


def _shift(batches):
    for batch in batches:
        crc = shift_crc(np.asarray(batch.column("crc").to_numpy(zero_copy_only=False)), batch.column("tail").to_numpy(zero_copy_only=False))
        keep = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "part"])


def verify_manifest(spark: SparkSession, root: str) -> bool:
    """Whether the roots of blocks and store, computed again from the recipes, equal the manifest."""
    kinds = "block int, block_root binary"

    def roots(batches):
        out: dict[int, Merkle] = {}
        for b in batches:
            for block, r in zip(b.column("block").to_pylist(), b.column("root").to_pylist()):
                out.setdefault(block, Merkle()).add(r)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([t.root() for t in out.values()], pa.binary())], names=["block", "block_root"])

    rows = recipes_of(spark, root).repartition("block").sortWithinPartitions("block", "doc_id", "root").select("block", "root")
    found = {r.block: bytes(r.block_root) for r in rows.mapInArrow(roots, kinds).collect()}
    manifest = spark.read.parquet(f"{root}/manifest").orderBy("block").collect()
    return {r.block: bytes(r.block_root) for r in manifest} == found and all(bytes(r.store_root) == merkle([bytes(x.block_root) for x in manifest]) for r in manifest)


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from the files.

    Every chunk is read and checked once; its CRC-32 then stands for its ids in all recipes that name it,
    since the CRC-32 of a stream is the xor of the shifted CRC-32s of its pieces.
    """
    chunks = _store(spark, root).filter("kind = 1").select("key", "payload").mapInArrow(_digest_chunks, "digest binary, crc long")
    uses = recipes_of(spark, root).select("doc_id", "start", "n_tokens", "digests", "tails", "root").mapInArrow(_expand, "doc_id long, start long, n_tokens long, digest binary, tail long")
    joined = uses.join(chunks, "digest", "left").withColumn("crc", F.coalesce("crc", F.raise_error(F.lit("a recipe names a chunk that the store lacks")).cast("long")))
    parts = joined.select("doc_id", "start", "n_tokens", "tail", "crc").mapInArrow(_shift, "doc_id long, start long, n_tokens long, part long")
    return parts.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.count("*").alias("n_chunks"))


def with_token_counts(documents: DataFrame, tokenizer_path: str | None = None, column: str = "n_tokens") -> DataFrame:
    """``documents`` with ``column``, the number of ids of its ``text`` (null: 0), in that column's place; no shuffle."""
    small_batches(documents.sparkSession)
    path, run_name = tokenizer_path or default_tokenizer(), uuid.uuid4().hex
    kept = [f for f in documents.schema.fields if f.name != "text"]

    def run(batches):
        encoder = _encoder(path, run_name)
        for part in slices(batches, "text", rows=500, size=1_000_000):
            counts = [len(raw) // 4 for raw in encoder.encode(pick(part, "text").to_pylist())]
            names = [n for n in part.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(counts, pa.int64())], names=[*names, column])

    return documents.mapInArrow(run, T.StructType([*kept, T.StructField(column, T.LongType())]))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_ids(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, ids (array<long>) of every document, rebuilt from its chunks."""
    kinds = "digest binary, ids array<long>"

    def run(batches):
        import zstandard

        reader = zstandard.ZstdDecompressor()
        for b in batches:
            ids = [unpack(x, reader).astype(np.int64) for x in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.list_(pa.int64()))], names=["digest", "ids"])

    chunks = _store(spark, root).filter("kind = 1").select("key", "payload").mapInArrow(run, kinds)
    uses = recipes_of(spark, root).select("doc_id", "start", F.posexplode("digests").alias("at", "digest"))
    whole = uses.join(chunks, "digest").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return whole.select("doc_id", "start", F.flatten("parts.ids").alias("ids"))


def token_store(documents: DataFrame, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the store for ``documents`` and return what reading it back yields (see ``read_digests``)."""
    spark = documents.sparkSession
    root = write_store(documents, tokenizer_path or default_tokenizer(), end_id)
    if not verify_manifest(spark, root):
        raise ValueError("the recipes do not match the manifest")
    return read_digests(spark, root)
