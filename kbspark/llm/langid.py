"""Operator 6: language identification by interpolated Kneser-Ney character models.

One model of order four per language, learnt from labelled documents; n-grams live in sorted hash arrays,
one for each order, whose rows hold the interpolated log-probabilities of all languages. A text gets the
language of lowest cross-entropy per character; calibration on labelled texts that the counts left out sets
the score's temperature and, for each language, the entropy beyond which a text is rejected.

Bounded sample: the models are fitted on at most about ``per_language`` documents for each language that has a
label, picked by a hash of doc_id, and on ``sample_chars`` characters of each, in PIECES pieces at hashed places
of the whole text. All languages together give at most about ``max_chars`` characters: many languages get fewer
documents each, and none is left out. Scoring reads whole texts.

Text is lower-cased; every run of non-letters is one space. Defined cases: null texts, empty texts and texts
without a letter are ``und`` with score 0 and rejected; without any labelled document everything is ``und``;
ties go to the smaller language value; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import mix64, own_columns, pick, slices, small_batches, to_batch

ORDER, PER_LANGUAGE, SAMPLE_CHARS, MAX_CHARS, PIECES = 4, 800, 3000, 40_000_000, 3
#: A text is rejected if it lies this many times further from its language than the 99.9 % point of calibration.
SLACK = 2.0
#: Or if its nats a character, times the root of its length, exceed those of a blind draw from the alphabet by this much.
BLIND = 4.0
_P = np.uint64(0x100000001B3)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, starts) of all texts, one after the other: ORDER - 1 spaces, then letters and single spaces."""
    pad, parts, starts, at = np.full(ORDER - 1, 32, dtype=np.uint32), [], [], 0
    for text in texts:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        codes = np.where(letter, codes, np.uint32(32))[keep]
        starts.append(at)
        parts += [pad, codes]
        at += len(pad) + len(codes)
    return np.concatenate(parts) if parts else pad[:0], np.asarray(starts, dtype=np.int64)


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k symbols ending at each position; positions before the k-th wrap around."""
    h = np.full(len(codes), k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for back in range(k - 1, -1, -1):
            h = h * _P + np.roll(codes, back).astype(np.uint64) + np.uint64(1)
    return mix64(h)


class Hashes:
    """A sorted array of distinct hashes with a directory on their high bits."""

    def __init__(self, values: np.ndarray):
        self.values = np.append(values, np.uint64(2**64 - 1))
        bits = max(8, int(np.ceil(np.log2(len(values) + 1))) + 2)
        self.shift = np.uint64(64 - bits)
        edges = np.arange(2**bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(values, edges).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash, -1 where it is absent."""
        at = self.first[h >> self.shift].astype(np.int64)
        todo = np.flatnonzero(self.values[at] < h)
        while len(todo):
            at[todo] += 1
            todo = todo[self.values[at[todo]] < h[todo]]
        return np.where(self.values[at] == h, np.minimum(at, len(self.values) - 2), -1)


class Model:
    """Kneser-Ney models of several languages over one set of sorted hash arrays."""

    def __init__(self, languages: list[str], texts: dict[str, list[str]]):
        self.languages = languages
        n, last = len(languages), {}
        per: list[dict] = []
        for name in languages:
            codes, starts = symbols(texts[name])
            scored = np.ones(len(codes), dtype=bool)
            for back in range(ORDER - 1):
                scored[starts + back] = False
            at = np.flatnonzero(scored)
            orders, counts = {}, None
            for k in range(ORDER, 0, -1):
                whole = grams(codes, k)
                if counts is None:
                    types, first, counts = np.unique(whole[at], return_index=True, return_counts=True)
                    where = at[first]
                else:
                    # Below the highest order a gram counts the distinct symbols seen before it.
                    types, first, counts = np.unique(whole[where], return_index=True, return_counts=True)
                    where = where[first]
                head = np.roll(grams(codes, k - 1), 1) if k > 1 else np.zeros(len(codes), dtype=np.uint64)
                tail = grams(codes, k - 1) if k > 1 else head
                orders[k] = (types, counts, head[where], tail[where])
            per.append(orders)
        self.tables: dict[int, tuple] = {}
        alphabet = len(np.unique(np.concatenate([o[1][0] for o in per]))) + 1
        for k in range(1, ORDER + 1):
            every = np.concatenate([o[k][0] for o in per])
            types, pick = np.unique(every, return_index=True)
            head = np.concatenate([o[k][2] for o in per])[pick]
            tail = np.concatenate([o[k][3] for o in per])[pick]
            heads = np.unique(head)
            prob, rest = np.zeros((len(types), n)), np.ones((len(heads), n))
            for j, o in enumerate(per):
                own, counts, own_head, _ = o[k]
                once, twice = int((counts == 1).sum()), int((counts == 2).sum())
                discount = min(max(once / (once + 2 * twice), 0.1), 0.95) if once else 0.5
                seat = np.searchsorted(heads, own_head)
                total = np.bincount(seat, weights=counts, minlength=len(heads))
                kinds = np.bincount(seat, minlength=len(heads))
                rest[:, j] = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
                prob[np.searchsorted(types, own), j] = (counts - discount) / total[seat]
            lower = np.full((len(types), n), 1.0 / alphabet) if k == 1 else last["prob"][np.searchsorted(last["types"], tail)]
            prob += rest[np.searchsorted(heads, head)] * lower
            last = {"types": types, "prob": prob}
            self.tables[k] = (Hashes(types), np.log(prob).astype(np.float32), Hashes(heads), np.log(rest).astype(np.float32))
        self.unseen = np.full(n, np.log(1.0 / alphabet), dtype=np.float32)
        self.temperature, self.centre, self.spread, self.limit = 1.0, np.zeros(n), np.ones(n), np.full(n, np.inf)

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters scored, nats per character under each language) for each text."""
        codes, starts = symbols(texts)
        ends = np.append(starts[1:], len(codes))
        lengths = ends - starts - (ORDER - 1)
        out = np.zeros((len(texts), len(self.languages)))
        if not len(codes):
            return lengths, out
        logp = np.zeros((len(codes), len(self.languages)), dtype=np.float32)
        scored = np.ones(len(codes), dtype=bool)
        for back in range(ORDER - 1):
            scored[starts + back] = False
        todo = np.flatnonzero(scored)
        for k in range(ORDER, 0, -1):
            types, prob, heads, rest = self.tables[k]
            whole = grams(codes, k)[todo]
            found = types.find(whole)
            hit = found >= 0
            logp[todo[hit]] += prob[found[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if k > 1:
                back = heads.find(np.roll(grams(codes, k - 1), 1)[todo])
                logp[todo[back >= 0]] += rest[back[back >= 0]]
            else:
                logp[todo] += rest_of_unigrams(rest) + self.unseen
        sums = np.add.reduceat(logp, starts, axis=0, dtype=np.float64)
        return lengths, -sums / np.maximum(lengths, 1)[:, None]

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        lengths, h = self.entropies(texts)
        right = np.asarray([self.languages.index(t) for t in truth], dtype=int)
        use = lengths > 0
        lengths, h, right = lengths[use], h[use], right[use]
        if not len(h):
            return
        gap = -(h - h.min(axis=1, keepdims=True)) * np.sqrt(lengths)[:, None]
        best = np.inf
        for t in (0.25, 0.5, 1, 2, 4, 8, 16):
            p = np.exp(gap * t)
            p = p[np.arange(len(p)), right] / p.sum(axis=1)
            loss = float(-np.log(np.maximum(p, 1e-6)).mean())
            if loss < best - 1e-9:
                best, self.temperature = loss, float(t)
        for j in range(len(self.languages)):
            own, n = h[right == j, j], lengths[right == j]
            if len(own) < 5:
                continue
            self.centre[j] = np.average(own, weights=n)
            away = (own - self.centre[j]) * np.sqrt(n)
            self.spread[j] = max(float(np.std(away)), 1e-3)
            self.limit[j] = SLACK * max(float(np.quantile(away / self.spread[j], 0.999)), 4.0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        lengths, h = self.entropies(texts)
        best = h.argmin(axis=1)
        p = np.exp(-(h - h.min(axis=1, keepdims=True)) * np.sqrt(np.maximum(lengths, 1))[:, None] * self.temperature)
        score = p[np.arange(len(p)), best] / p.sum(axis=1)
        away = (h[np.arange(len(h)), best] - self.centre[best]) * np.sqrt(np.maximum(lengths, 1)) / self.spread[best]
        # Whatever the calibration: text less likely than letters drawn blindly is no text of a language learnt.
        blind = (h[np.arange(len(h)), best] + self.unseen[0]) * np.sqrt(np.maximum(lengths, 1)) > BLIND
        odd = (away > self.limit[best]) | blind
        return [(self.languages[b], float(s), bool(o)) if n else ("und", 0.0, True) for n, b, s, o in zip(lengths, best, score, odd)]


def rest_of_unigrams(rest: np.ndarray) -> np.ndarray:
    """What the unigrams of each language leave to symbols that no language has shown."""
    return rest[0]


def train_rows(doc_id: Column) -> Column:
    """Rows that may be learnt from: crc32 of doc_id as text, modulo 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(True))


def sampled(text: Column, seed: Column, chars: int) -> Column:
    """``chars`` characters of a text, in PIECES pieces at hashed places, joined by line feeds; a shorter text whole."""
    size = chars // PIECES
    at = [F.pmod(F.xxhash64(seed, F.lit(i)), F.length(text) - size + 1).cast("int") + 1 for i in range(PIECES)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws("\n", *(F.substring(text, a, F.lit(size)) for a in at)))


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS, max_chars: int = MAX_CHARS) -> Model | None:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang); a fifth of it calibrates."""
    rows = labelled.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).filter(r"lang is not null and text rlike '\\p{L}'")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    per_language = min(per_language, max(2, max_chars // (sample_chars * len(sizes))))
    shares = {lang: min(1.0, per_language / n) for lang, n in sizes.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("lang")]
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(1_000_000)) / 1e6
    sample = rows.filter(draw < share).select("lang", "doc_id", sampled(F.col("text"), F.coalesce("doc_id", F.lit(0)), sample_chars).alias("text")).collect()
    sample = sorted((r.lang, r.doc_id or 0, r.text) for r in sample)
    texts: dict[str, list[str]] = {}
    kept: list[tuple[str, str]] = []
    for i, (lang, _, text) in enumerate(sample):
        if i % 5 == 4 and lang in texts:
            kept.append((text, lang))
        else:
            texts.setdefault(lang, []).append(text)
    if not texts:
        return None
    model = Model(sorted(texts), texts)
    model.calibrate(*map(list, zip(*kept)) if kept else ([], []))
    return model


_ARROW = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def keep_identified(documents: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``documents`` that the models do not reject, with their own columns.

    The document travels as one struct, so no name of its columns can clash with a result's.
    """
    return identify(documents.select(F.struct(*own_columns(documents)).alias("row")), model, "row.text").filter("not rejected").select("row.*")


def identify(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score (0 to 1) and rejected after its own columns; whole texts, no shuffle.

    ``text`` names the text column, or a field of a struct column.
    """
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = held.value
        for part in slices(batches, text, rows=400, size=400_000):
            texts = pick(part, text).to_pylist()
            found = judge.predict(texts) if judge else [("und", 0.0, True)] * len(texts)
            more = to_batch(dict(zip(_ARROW.names, map(list, zip(*found)))), _ARROW)
            yield pa.RecordBatch.from_arrays([*part.columns, *more.columns], names=[*part.schema.names, *_ARROW.names])

    kinds = [T.StructField(n, k) for n, k in zip(_ARROW.names, (T.StringType(), T.DoubleType(), T.BooleanType()))]
    return documents.mapInArrow(run, T.StructType([*documents.schema.fields, *kinds]))


def identify_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, by models learnt from the rows that are not held out."""
    model = fit(documents.filter(train_rows(F.col("doc_id"))))
    out = identify(documents.select("doc_id", "text"), model)
    return out.select("doc_id", (~train_rows(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected")
