"""Operator 12: alignment of two tokenizers' tokens over the bytes of each text.

Both tokenizers' ids become byte-owner arrays: the index of each token repeated over its bytes. Where either
owner changes a new pair of overlapping tokens begins, where both change at once both tokenizations cut. A
batch of texts is one pair of arrays. Per text the different (A id, B id) pairs with their numbers are kept;
how many documents hold a pair, and each A id's highest such number, are counted over the corpus.

Counts meet the texts' pairs in a join that no pair can skew: the pairs held most often, at most ``KNOWN`` of
them by a cut on their count, are broadcast; every other pair is then held by fewer documents than all pairs
together over ``KNOWN``, so its rows are few and are joined by a shuffle.

Defined cases: null and empty texts, and texts whose tokens' bytes are not a space and the text, have no
tokens; strings of special tokens are plain text; rows are documents, repeated ones too; extra columns are
ignored; no rows give no rows. A text is aligned as a whole: a task holds one text's arrays, about 60 bytes for
each of its bytes.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, slices, small_batches, to_batch
from kbspark.llm.tokenstore import _MARK, WordEncoder, _plain

#: Most pairs that are broadcast with their counts; steps of a count's logarithm by which they are chosen.
KNOWN, STEPS = 500_000, 16
_SHIFT = 24

_ROWS = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


class SpacedEncoder(WordEncoder):
    """Encodes a space and the text, with words remembered as they are between other words."""

    def encode_spaced(self, texts: list[str]) -> list[bytes]:
        plain = [_plain(t) for t in texts]
        # The mark alone is a piece without ids; the first word is then like every other.
        flat = "".join([f"{_MARK} {t}" for t, p in zip(texts, plain) if p])
        found = self._encode_flat(flat) if flat else None
        if found is None:
            return self._bytes([f" {t}" for t in texts])
        whole = iter(self._bytes([f" {t}" for t, p in zip(texts, plain) if not p]))
        raw, ends = found[0].astype("<u4").tobytes(), np.cumsum(4 * found[1]).tolist()
        cut = iter([raw[a:b] for a, b in zip([0, *ends], ends)])
        return [next(cut) if p else next(whole) for p in plain]


class Strings:
    """Byte strings by number, in one array."""

    def __init__(self, strings: list[bytes]):
        self.size = np.asarray([len(x) for x in strings], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.values = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        """The bytes of the strings of ``numbers``, one after the other."""
        n = self.size[numbers]
        ends = np.cumsum(n)
        return self.values[np.arange(int(ends[-1]) if len(n) else 0) + np.repeat(self.start[numbers] - ends + n, n)]


def _byte_level() -> dict[str, int]:
    """Byte-level tokenizers write printable bytes as themselves and the others, in order, from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Aligner:
    """Two tokenizers with the bytes of all their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a, self.b = SpacedEncoder(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        level, n_a = _byte_level(), self.a.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.a.tokenizer.id_to_token(i) or "" for i in range(n_a)]
        self.a_bytes = Strings([bytes([level[c] for c in x]) if all(c in level for c in x) else x.encode() for x in names])
        self.b_bytes = Strings([_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())])
        # Each id as written, with the mark behind it: another of its side, the other side, the next group.
        self.written = Strings([b"%d%s" % (i, mark) for mark in (b",", b"|", b";") for i in range(max(n_a, self.b.get_piece_size()))])
        self.n_written = max(n_a, self.b.get_piece_size())

    def align(self, texts: list[str | None]) -> dict:
        """Columns of ``_ROWS`` but doc_id."""
        given = [i for i, t in enumerate(texts) if t]
        own = [texts[i] for i in given]
        a = [np.frombuffer(x, dtype="<u4").astype(np.int64) for x in self.a.encode_spaced(own)]
        b = [np.asarray(x, dtype=np.int64) for x in self.b.encode(own, num_threads=1)] if own else []
        want = [b" " + t.encode() for t in own]
        if not self._equal(a, b, b"".join(want)):
            good = [self._equal([x], [y], t) for x, y, t in zip(a, b, want)]
            given, a, b, want = ([v for v, g in zip(z, good) if g] for z in (given, a, b, want))
        out = {"n_a": np.zeros(len(texts), dtype=np.int64), "n_b": np.zeros(len(texts), dtype=np.int64), "n_groups": np.zeros(len(texts), dtype=np.int64), "n_links": np.zeros(len(texts), dtype=np.int64)}
        prints, pairs, times = [""] * len(texts), [[]] * len(texts), [[]] * len(texts)
        if given:
            self._aligned(np.asarray(given), a, b, np.asarray([len(x) for x in want], dtype=np.int64), out, prints, pairs, times)
        return out | {"groups_sha256": prints, "pairs": pairs, "times": times}

    def _equal(self, a: list[np.ndarray], b: list[np.ndarray], want: bytes) -> bool:
        bytes_of = lambda ids, strings: strings.join(np.concatenate(ids)) if ids else np.zeros(0, dtype=np.uint8)
        wanted = np.frombuffer(want, dtype=np.uint8)
        return np.array_equal(bytes_of(a, self.a_bytes), wanted) and np.array_equal(bytes_of(b, self.b_bytes), wanted)

    def _aligned(self, given, a, b, n_bytes, out, prints, pairs, times) -> None:
        n_a, n_b = (np.asarray([len(x) for x in z], dtype=np.int64) for z in (a, b))
        a, b = np.concatenate(a), np.concatenate(b)
        owner_a = np.repeat(np.arange(len(a)), self.a_bytes.size[a])
        owner_b = np.repeat(np.arange(len(b)), self.b_bytes.size[b])
        new_a, new_b = (np.append(True, x[1:] != x[:-1]) for x in (owner_a, owner_b))
        # Overlaps: a byte at which either owner changes begins the next pair. Cuts: both change.
        begins = np.flatnonzero(new_a | new_b)
        link_a, link_b = owner_a[begins], owner_b[begins]
        cut = np.flatnonzero(new_a & new_b)
        ends = np.cumsum(n_bytes)
        doc_links = np.searchsorted(ends, begins, side="right")
        doc_groups = np.searchsorted(ends, cut, side="right")
        n_links, n_groups = np.bincount(doc_links, minlength=len(given)), np.bincount(doc_groups, minlength=len(given))
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links)):
            out[name][given] = values
        # Different pairs of each text with their numbers.
        texts_at, codes = doc_links, (a[link_a] << _SHIFT) | b[link_b]
        order = np.lexsort((codes, texts_at))
        codes, texts_at = codes[order], texts_at[order]
        first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (texts_at[1:] != texts_at[:-1])))
        number = np.diff(np.append(first, len(codes))).astype(np.int32)
        bounds = np.searchsorted(texts_at[first], np.arange(len(given) + 1)).tolist()
        # Written form: the A ids of a group, then its B ids.
        group_a, group_b = (np.cumsum(new_a & new_b)[np.flatnonzero(new)] - 1 for new in (new_a, new_b))
        per_a, per_b = np.bincount(group_a, minlength=len(cut)), np.bincount(group_b, minlength=len(cut))
        at_a = np.arange(len(a)) + (np.cumsum(per_b) - per_b)[group_a]
        at_b = np.arange(len(b)) + np.cumsum(per_a)[group_b]
        marks_a = np.append(group_a[1:] != group_a[:-1], True).astype(np.int64)
        marks_b = 2 * np.append(group_b[1:] != group_b[:-1], True).astype(np.int64)
        sequence = np.empty(len(a) + len(b), dtype=np.int64)
        sequence[at_a], sequence[at_b] = a + marks_a * self.n_written, b + marks_b * self.n_written
        written = self.written.join(sequence).tobytes()
        stops = np.cumsum(self.written.size[sequence])[np.cumsum(n_a + n_b) - 1].tolist()
        for i, at, to, lo, hi in zip(given.tolist(), [0, *stops], stops, bounds, bounds[1:]):
            prints[i] = hashlib.sha256(memoryview(written)[at : to - 1]).hexdigest()
            pairs[i], times[i] = codes[first[lo:hi]], number[lo:hi]


@functools.lru_cache(maxsize=1)
def _aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _align(a_path: str, b_path: str):
    def run(batches):
        aligner = _aligner(a_path, b_path)
        for part in slices(batches, "text", rows=500, size=1_000_000):
            yield to_batch({"doc_id": part.column("doc_id")} | aligner.align(part.column("text").to_pylist()), _ROWS)

    return run


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each text by itself."""
    small_batches(docs.sparkSession, "4m")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_align(a_path, b_path), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many texts hold each pair, and whether no other pair of its A id is held by more."""
    counts = materialise(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "counts")
    a = F.shiftright("pair", _SHIFT).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    out = materialise(counts.withColumn("a", F.shiftright("pair", _SHIFT)).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pairs")
    discard(counts)
    return out


def _least_known(counts: DataFrame, known: int) -> int:
    """The step from which on at most ``known`` pairs have their counts; there are no more than 64 * STEPS steps."""
    steps = sorted(((r.step, r.pairs) for r in counts.groupBy(_step().alias("step")).agg(F.count("*").alias("pairs")).collect()), reverse=True)
    total, least = 0, 1 << 30
    for step, pairs in steps:
        total += pairs
        if total > known:
            break
        least = step
    return least


def _step():
    return F.floor(F.log2("n") * STEPS)


def token_alignment(docs: DataFrame, a_path: str, b_path: str, known: int = KNOWN) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    aligned = materialise(aligned_texts(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned)
    least = _least_known(counts, known)
    each = aligned.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    # At most ``known`` rows.
    near = F.broadcast(counts.filter(_step() >= least))
    sums = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    found = each.join(near, "pair").groupBy("row").agg(*sums)
    rest = each.join(near.select("pair"), "pair", "left_anti").join(counts.filter(_step() < least), "pair").groupBy("row").agg(*sums)
    found = found.unionByName(rest).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    nothing = F.lit(0).cast("long")
    out = aligned.drop("pairs", "times").join(found, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nothing).alias("n_best"), F.coalesce("count_sum", nothing).alias("count_sum"), "groups_sha256")
