"""Operator 9: benchmark decontamination by a BM25 inverted index with block-max WAND.

Test items are the indexed side, in blocks of similar threshold; every passage of every document queries
them. An item of more than PIECE words is indexed as pieces of at most so many. A passage is dropped when the
sum of its terms' largest impacts cannot reach the smallest threshold; else each block whose block maxima
cannot reach the block's smallest threshold is skipped; the postings of the blocks left are summed exactly,
and every piece at or over its threshold (``share`` of the score that it has with itself) is retrieved. A hit
counts when the question's five-word shingles and the answer's words are found around the passage: in it, and
as far before and behind as the item reaches.

The answer of an item is its last sentence, the question what comes before; an item of one sentence is both.
BM25 statistics (items and their mean length, document frequencies) are counted over the whole benchmark with
Spark. The index is held in parts of at most PART_PIECES pieces and PART_POSTINGS postings, each broadcast by
itself; a task reads its documents once and meets the parts one after the other, so results do not depend on
the parts, and documents are read whole, once, and never shuffled.

Defined cases: null and empty texts and items match nothing; repeated documents and items give repeated
rows; a question of fewer than five words is one shingle, of its own length; words in order stand in for
shingles, in runs of two pieces; an empty table on either side gives an empty result; extra columns
are ignored. Passages are two pieces long and begin every piece.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, slices, small_batches, to_batch

K1, B, SHARE, BLOCK = 1.2, 0.75, 0.6, 8
SHINGLE, QUESTION, ANSWER, IN_ORDER = 5, 0.8, 0.5, 0.85
#: Words of a piece, and what one part of the index may hold.
PIECE, PART_PIECES, PART_POSTINGS = 64, 20_000, 1_000_000
_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")

_SCHEMA = "doc_id long, item_id long, score double, threshold double, question_overlap double, answer_overlap double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), *((c, pa.float64()) for c in ("score", "threshold", "question_overlap", "answer_overlap"))])


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def split_item(text: str) -> tuple[list[str], list[str]]:
    """(question words, answer words) of a test item."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) < 2:
        return (parts or [[]])[0], (parts or [[]])[0]
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def pieces_of(words: list[str], most: int = PIECE) -> list[list[str]]:
    """Equal runs of at most ``most`` words."""
    n = -(-len(words) // most)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


class Index:
    """Impacts of the terms of pieces, as postings sorted by (term, block, piece).

    ``pieces``: (row of the item, item_id, its text, {word: (count, document frequency)}); ``n`` and ``mean``:
    number and mean length of all pieces of the benchmark.
    """

    def __init__(self, pieces: list[tuple[int, int, str, dict[str, tuple[int, int]]]], n: int, mean: float, share: float = SHARE):
        total, n = n, len(pieces)
        idf = {w: np.log(1 + (total - d + 0.5) / (d + 0.5)) for x in pieces for w, (_, d) in x[3].items()}
        lengths = [sum(c for c, _ in x[3].values()) for x in pieces]
        impact = [{w: idf[w] * c * (K1 + 1) / (c + K1 * (1 - B + B * length / mean)) for w, (c, _) in sorted(x[3].items())} for x, length in zip(pieces, lengths)]
        items, df = pieces, idf
        order = sorted(range(n), key=lambda i: (sum(impact[i].values()), items[i][:2]))
        self.items = [items[i] for i in order]
        self.threshold = np.asarray([share * sum(impact[i].values()) for i in order])
        self.vocabulary = {w: i for i, w in enumerate(sorted(df))}
        self.blocks = -(-n // BLOCK)
        rows = sorted((self.vocabulary[w], at, v) for at, i in enumerate(order) for w, v in impact[i].items())
        terms, self.at, self.impact = (np.asarray(x) for x in (zip(*rows) if rows else ([0][:0], [0][:0], [0.0][:0])))
        self.at = self.at.astype(np.int64)
        key = terms.astype(np.int64) * max(self.blocks, 1) + self.at // BLOCK
        self.keys, self.first = np.unique(key, return_index=True)
        self.end = np.append(self.first[1:], len(key))
        self.top = np.maximum.reduceat(self.impact, self.first) if len(key) else np.zeros(0)
        self.key_first = np.searchsorted(self.keys, np.arange(len(df) + 1, dtype=np.int64) * max(self.blocks, 1))
        self.term_top = np.zeros(len(df))
        np.maximum.at(self.term_top, terms.astype(np.int64), self.impact)
        self.block_threshold = np.asarray([self.threshold[b * BLOCK : (b + 1) * BLOCK].min() for b in range(self.blocks)])

    def retrieve(self, ids: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item position, score) of all at or over threshold.

        ``ids`` and ``passage``: the distinct terms of each passage, sorted by passage.
        """
        none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
        if not len(ids) or not self.blocks:
            return none
        # WAND: no item can reach its threshold if the terms' largest impacts together cannot.
        seats, first, seat = np.unique(passage, return_index=True, return_inverse=True)
        bound = np.add.reduceat(self.term_top[ids], first)
        live = (bound >= self.threshold.min() - 1e-9)[seat]
        ids, seat = ids[live], seat[live]
        # Block-max: the same for each block that has a posting of the passage.
        k, owner = _ranges(self.key_first[ids], self.key_first[ids + 1])
        cell = seat[owner] * self.blocks + self.keys[k] % self.blocks
        cells, where = np.unique(cell, return_inverse=True)
        bound = np.bincount(where, weights=self.top[k], minlength=len(cells))
        live = (bound >= self.block_threshold[cells % self.blocks] - 1e-9)[where] if len(cells) else np.zeros(0, dtype=bool)
        k, cell = k[live], cell[live]
        # What is left is summed posting by posting.
        p, owner = _ranges(self.first[k], self.end[k])
        pair = (cell[owner] // self.blocks) * len(self.items) + self.at[p]
        pairs, where = np.unique(pair, return_inverse=True)
        score = np.bincount(where, weights=self.impact[p], minlength=len(pairs))
        at = pairs % len(self.items)
        hit = score >= self.threshold[at] - 1e-9
        return seats[pairs[hit] // len(self.items)], at[hit], score[hit]


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges one after the other, and the range that each is of."""
    n = end - start
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n), owner


def in_order(question: list[str], words: list[str]) -> int:
    """Words of the question that ``words`` hold in order, in runs of two or more.

    A question of more than two pieces is compared run by run, each where most of its word pairs are found (else
    where the run before it was): the work grows with its length, and no length changes what is found.
    """
    most = 2 * PIECE
    runs = pieces_of(question, most)
    places: dict[tuple[str, str], list[int]] = {}
    if len(runs) > 1:
        for j, pair in enumerate(zip(words, words[1:])):
            places.setdefault(pair, []).append(j)
    found = at = shift = 0
    for run in runs:
        near = words
        if len(runs) > 1:
            shifts = Counter(j - at - i for i, pair in enumerate(zip(run, run[1:])) for j in places.get(pair, ())[:most])
            shift = min(shifts, key=lambda s: (-shifts[s], abs(s - shift))) if shifts else shift
            near = words[max(0, at + shift - PIECE) : max(0, at + shift + len(run) + PIECE)]
        found += sum(b.size for b in SequenceMatcher(None, run, near, autojunk=False).get_matching_blocks() if b.size > 1)
        at += len(run)
    return found


def overlaps(words: list[str], question: list[str], answer: list[str]) -> tuple[float, float]:
    """Shares of the question (its shingles among ``words``, or its words in order) and of the answer's words."""
    n = min(SHINGLE, max(1, len(question)))
    asked = shingles(question, n)
    q = len(asked & shingles(words, n)) / len(asked) if asked else 0.0
    if q < QUESTION and question:
        order = in_order(question, words) / len(question)
        q = max(q, order) if order >= IN_ORDER else q
    told = set(words)
    return q, sum(w in told for w in answer) / len(answer) if answer else 0.0


class _Batch:
    """Words of some documents, cut into passages."""

    def __init__(self, doc_ids: list, texts: list):
        self.doc_ids, self.words = doc_ids, [words_of(t) for t in texts]
        halves = [len(w) // PIECE + 2 for w in self.words]
        self.first = np.cumsum(halves) - halves
        self.owner = np.repeat(np.arange(len(texts)), halves)

    def search(self, index: Index, split: list, out: dict) -> None:
        get, ids, segs = index.vocabulary.get, [], []
        for words, base in zip(self.words, self.first.tolist()):
            own = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
            at = np.flatnonzero(own >= 0)
            ids.append(own[at])
            segs.append(base + at // PIECE)
        ids, segs = np.concatenate(ids), np.concatenate(segs)
        # A passage is a half and the next: its terms are those of either.
        v = max(len(index.vocabulary), 1)
        own = np.unique(segs * v + ids)
        pairs = np.union1d(own, own[(own // v > 0)] - v)
        passage, item, score = index.retrieve(pairs % v, pairs // v)
        best: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int, int], tuple[float, float]] = {}
        for p, i, s in zip(passage.tolist(), item.tolist(), score.tolist()):
            doc = int(self.owner[p])
            at, (question, answer, length) = (p - int(self.first[doc])) * PIECE, split[i]
            reach = PIECE + max(0, length - PIECE)
            # All pieces of a long item lead to the same few places of a document: each is looked at once.
            grid = PIECE * max(1, length // (4 * PIECE))
            at, key = at // grid * grid, (doc, index.items[i][0])
            if (*key, at) not in seen:
                seen[*key, at] = overlaps(self.words[doc][max(0, at - reach) : at + grid + PIECE + reach], question, answer)
            q, a = seen[*key, at]
            if q >= QUESTION and a >= ANSWER and (s, q, a) > best.get(key, (-1.0,))[:3]:
                best[key] = (s, q, a, index.items[i][1], float(index.threshold[i]))
        for (doc, _), (s, q, a, item_id, threshold) in best.items():
            for k, x in zip(out, (self.doc_ids[doc], item_id, s, threshold, q, a)):
                out[k].append(x)


def _split(index: Index) -> list:
    found = {row: (*split_item(text), len(words_of(text))) for row, _, text, _ in index.items}
    return [found[x[0]] for x in index.items]


def _search(parts: list):
    def run(batches):
        held = None
        if len(parts) == 1:
            held = parts[0].value, _split(parts[0].value)
        # Several parts are read again for every batch: larger batches then.
        for part in slices(batches, "text", rows=300, size=1_000_000) if held else batches:
            if not part.num_rows:
                continue
            own = [_Batch(x.column("doc_id").to_pylist(), x.column("text").to_pylist()) for x in ([part] if held else slices([part], "text", rows=300, size=1_000_000))]
            for share in parts:
                index, split = held or (share.value, _split(share.value))
                out = {f.name: [] for f in _ARROW}
                for batch in own:
                    batch.search(index, split, out)
                yield to_batch(out, _ARROW)
                if not held and getattr(share, "_path", None):
                    # The worker keeps one part at a time; the next batch reads this one from its file again.
                    share.__dict__.pop("_value", None)

    return run


_PIECES = "row long, item_id long, piece int, words array<string>, counts array<int>"
_PIECES_ARROW = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("piece", pa.int32()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int32()))])


def _cut(batches):
    for batch in batches:
        out = {f.name: [] for f in _PIECES_ARROW}
        for row, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "item_id", "text"))):
            for at, words in enumerate(pieces_of(words_of(text))):
                counts = Counter(words)
                for k, v in zip(out, (row, item_id, at, list(counts), list(counts.values()))):
                    out[k].append(v)
        yield to_batch(out, _PIECES_ARROW)


def build_index(benchmark: DataFrame, share: float = SHARE):
    """Yields the parts of the index of ``benchmark`` (item_id, text), one at a time, with the statistics of all of it."""
    items = benchmark.selectExpr("cast(item_id as long) as item_id", "cast(text as string) as text").filter("text is not null")
    items = materialise(items.withColumn("row", F.monotonically_increasing_id()), "items")
    pieces = materialise(items.select("row", "item_id", "text").mapInArrow(_cut, _PIECES), "pieces")
    size = pieces.agg(F.count("*").alias("n"), F.sum(F.aggregate("counts", F.lit(0), lambda a, x: a + x)).alias("words"), F.sum(F.size("words")).alias("postings")).first()
    if not size.n:
        discard(items, pieces)
        return
    flat = pieces.select("row", "piece", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("row", "piece", F.col("x.words").alias("word"), F.col("x.counts").alias("c"))
    df = flat.groupBy("word").agg(F.count("*").alias("df"))
    terms = flat.join(df, "word").groupBy("row", "piece").agg(F.collect_list(F.struct("word", "c", "df")).alias("terms"))
    ready = materialise(pieces.select("row", "piece", "item_id").join(terms, ["row", "piece"]), "ready")
    parts = max(1, -(-size.n // PART_PIECES), -(-size.postings // PART_POSTINGS))
    for part in range(parts):
        # About a part's bound of rows is on the driver at a time.
        mine = F.pmod(F.xxhash64("row"), F.lit(parts)) == part
        # An item's text once; all its pieces name it.
        texts = {r.row: r.text for r in items.filter(mine).select("row", "text").toLocalIterator()}
        rows = sorted(((r.row, r.piece, r.item_id, texts[r.row], {t.word: (t.c, t.df) for t in r.terms}) for r in ready.filter(mine).toLocalIterator()), key=lambda r: r[:2])
        if rows:
            yield Index([(r[0], *r[2:]) for r in rows], size.n, size.words / size.n, share)
    discard(items, pieces, ready)


def find_leaks(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, score, threshold, question_overlap, answer_overlap) of every verified leak."""
    spark = documents.sparkSession
    small_batches(spark)
    docs = documents.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")
    parts = [spark.sparkContext.broadcast(x) for x in build_index(benchmark, share)]
    if not parts:
        return spark.createDataFrame([], _SCHEMA)
    # Leaks are few: written, so that the index leaves the cluster with this call.
    found = materialise(docs.mapInArrow(_search(parts), _SCHEMA), "leaks")
    for part in parts:
        part.destroy()
    return found


def decontaminate(documents: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``documents`` without a verified leak; a document of repeated doc_id goes if one of its rows leaks."""
    leaks = find_leaks(documents, benchmark, share).select("doc_id").distinct()
    return documents.join(leaks, "doc_id", "left_anti")
