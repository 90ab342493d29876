"""Operator 7: near-duplicate classes by BagMinHash over word shingles.

A document is the multiset of its five-word shingles. Each (shingle, multiplicity) owns a hierarchy of
Poisson processes over dyadic weight ranges [0,1), [1,2), [2,4), ...: ranges that lie within the
multiplicity count whole; of the range that holds it only points below the multiplicity count (the others
are rejected). The first arrivals in M components are the signature; two components agree with a probability that is the weighted
Jaccard similarity. Points are made in order of arrival and only while they can still lower a component.

Signatures are banded. Documents with equal multisets are one class member from the start; of the others,
every bucket links its members to a centre; where several components still meet in a bucket, every pair of
members of different components is compared whose sizes and shared-shingle counts do not prove it to be under
the threshold. Large buckets and centres of many members are dealt out in parts, whose number follows their
size. Comparisons are multiset similarities of whole texts, over 64-bit hashes of their shingles (texts count as
equal by a 128-bit digest of these); classes are the connected components of the
pairs at or over the threshold. With BANDS bands of ROWS rows a pair at 0.8 shares no bucket with
probability 3e-5.

Defined cases: null and empty texts, and texts without a word, are classes of their own; texts of one to
four words are one shingle; rows with equal doc_id are one document, compared by the text of most
shingles; a null doc_id has a null class; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import discard, materialise, mix64, shuffled, slices, small_batches, span_hashes, to_batch
from kbspark.llm.components import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
M = BANDS * ROWS
#: Hash cells by which shared items are counted to bound similarities.
CELLS = 64
#: About how many members of a bucket, or partners of a centre, one task takes at a time.
PART, SALTS = 128, 16
_Q, _GOLD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _word_characters() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() or c == 95 for c in range(0x110000)), dtype=bool, count=0x110000)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of all lower-cased words, number of words of each text)."""
    texts = [(t or "").lower() for t in texts]
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.asarray([len(t) + 1 for t in texts])
    word = _word_characters()[codes]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    start, end = edge[::2], edge[1::2]
    hashes = span_hashes(codes, start, end)
    ends = np.cumsum(lengths)
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes, counts


def shingle_bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct shingle hashes, multiplicities) of each text."""
    words, counts = word_hashes(texts)
    out, at = [], 0
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(words) - WORDS + 1, 0), dtype=np.uint64)
        for j in range(WORDS):
            rolled = rolled * _Q + words[j : j + len(rolled)]
        rolled = mix64(rolled)
        for n in counts.tolist():
            if n >= WORDS:
                out.append(np.unique(rolled[at : at + n - WORDS + 1], return_counts=True))
            else:
                h = np.uint64(n)
                for w in words[at : at + n]:
                    h = h * _Q + w
                out.append((mix64(np.asarray([h] * min(n, 1), dtype=np.uint64)), np.ones(min(n, 1), dtype=np.int64)))
            at += n
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """First arrivals of each bag in M components; infinite for an empty bag."""
    best = np.full((len(bags), M), np.inf)
    flat = best.reshape(-1)
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    if not len(doc):
        return best
    shingle, count = np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]).astype(np.int64)
    with np.errstate(over="ignore"):
        docs, seeds, rates, limits = [], [], [], []
        low, width, level = 0, 1, 0
        own = np.arange(len(doc))
        while len(own):
            docs.append(doc[own])
            seeds.append(mix64(shingle[own] + np.uint64(level) * _GOLD))
            rates.append(np.full(len(own), 1.0 / width))
            limits.append(np.minimum(count[own] - low, width))
            low, level = low + width, level + 1
            width = low
            own = own[count[own] > low]
        doc, seed, mean, limit = map(np.concatenate, (docs, seeds, rates, limits))
        width = np.rint(1.0 / mean).astype(np.int64)
        thin = limit < width
        time, turn, top = np.zeros(len(doc)), 0, np.full(len(bags), np.inf)
        while len(doc):
            turn += 1
            draw = mix64(seed + np.uint64(turn) * _GOLD)
            time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * mean
            place = mix64(draw ^ np.uint64(0x5851F42D4C957F2D))
            at = doc * M + ((place >> np.uint64(32)) * np.uint64(M) >> np.uint64(32)).astype(np.int64)
            value = time
            if thin.any():
                # A point at or beyond the multiplicity is none of this bag's.
                inside = ~thin | ((place & np.uint64(0xFFFFFFFF)).astype(np.int64) % width < limit)
                at, value = at[inside], time[inside]
            np.minimum.at(flat, at, value)
            if turn < 4 or turn % 4 == 0:
                live = np.flatnonzero(np.bincount(doc, minlength=len(bags)))
                top[live] = best[live].max(axis=1)
                on = time <= top[doc]
                doc, seed, mean, limit, width, thin, time = (x[on] for x in (doc, seed, mean, limit, width, thin, time))
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        bits, out = best.view(np.uint64).reshape(len(best), BANDS, ROWS), np.zeros((len(best), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            out = mix64(out * _Q + bits[:, :, r])
    return out.view(np.int64)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
_BAG = pa.schema([("rep", pa.int64()), ("items", pa.list_(pa.int64())), ("cells", pa.list_(pa.int32()))])


def occurrences(bag: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A bag as a set: one item for each occurrence, so that set similarity is the bag's."""
    shingle, count = bag
    if not len(count) or count.max() == 1:
        return shingle.view(np.int64)
    turn = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    every = np.repeat(shingle, count)
    with np.errstate(over="ignore"):
        return np.where(turn == 0, every, mix64(every + turn.astype(np.uint64) * _GOLD)).view(np.int64)


def _sign(batches):
    for part in slices(batches, "text", rows=400, size=600_000):
        bags = shingle_bags(part.column("text").to_pylist())
        keys = band_keys(signatures(bags))
        prints = [hashlib.blake2b(x.tobytes() + c.astype(np.int64).tobytes(), digest_size=16).digest() for x, c in bags]
        yield to_batch({"doc_id": part.column("doc_id"), "print": prints, "n": [int(c.sum()) for _, c in bags], "bands": list(keys)}, _SIGNED)


def _bags(batches):
    for part in slices(batches, "text", rows=400, size=400_000):
        items = [occurrences(b) for b in shingle_bags(part.column("text").to_pylist())]
        cells = [np.bincount(i & (CELLS - 1), minlength=CELLS) for i in items]
        yield to_batch({"rep": part.column("doc_id"), "items": items, "cells": cells}, _BAG)


def _compare(threshold: float):
    """Rows come as a centre's bag (kind 0), then those to compare with it; yields the pairs at or over the threshold."""
    kinds = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        hub = centre = None
        for batch in batches:
            out = {"a": [], "b": []}
            items = batch.column("items")
            values, ends = items.values.to_numpy(), items.offsets.to_numpy()
            for i, (h, kind, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "other")))):
                own = values[ends[i] : ends[i + 1]]
                if kind == 0:
                    hub, centre = h, np.sort(own)
                    continue
                assert h == hub
                at = np.minimum(np.searchsorted(centre, own), len(centre) - 1)
                both = int((centre[at] == own).sum())
                if both >= threshold * (len(centre) + len(own) - both):
                    out["a"].append(min(h, other))
                    out["b"].append(max(h, other))
            yield to_batch(out, kinds)

    return run


class _Search:
    """Candidate pairs of class representatives, verified against their bags."""

    def __init__(self, docs: DataFrame, members: DataFrame, threshold: float):
        self.docs, self.members, self.threshold = docs, members, threshold
        self.tested = self.edges = self.bags = None
        self.tables: list[DataFrame] = []

    def verify(self, pairs: DataFrame) -> int:
        """Compare new pairs (hub, other); returns how many there were."""
        pairs = pairs.filter("hub <> other").select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "hub")
        pairs = pairs.groupBy("a", "b").agg(F.min("hub").alias("hub"))
        if self.tested is not None:
            pairs = pairs.join(shuffled(self.tested.select("a", "b")), ["a", "b"], "left_anti")
        pairs = self._keep(pairs, "pairs")
        n = pairs.count()
        if not n:
            return 0
        ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        if self.bags is not None:
            ids = ids.join(shuffled(self.bags.select(F.col("rep").alias("doc_id"))), "doc_id", "left_anti")
        rows = self.docs.join(shuffled(ids), "doc_id", "left_semi").mapInArrow(_bags, "rep long, items array<long>, cells array<int>")
        best = F.max_by(F.struct("items", "cells"), F.struct(F.size("items"), "items")).alias("bag")
        more = self._keep(rows.groupBy("rep").agg(best).select("rep", "bag.*"), "bags")
        self.bags = more if self.bags is None else self.bags.unionByName(more)
        # A centre's bag goes once to each part of its partners; each partner's bag goes once for the pair.
        hubs = self._keep(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "hubs")
        other = pairs.join(shuffled(hubs), "hub").withColumn("other", F.col("a") + F.col("b") - F.col("hub"))
        other = other.select("hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "other")
        centre = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("hub").alias("other"))
        units = [u.join(shuffled(self.bags.select(F.col("rep").alias("other"), "items")), "other").select("hub", "part", "kind", "other", "items") for u in (centre, other)]
        units = units[0].unionByName(units[1]).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
        good = self._keep(units.mapInArrow(_compare(self.threshold), "a long, b long"), "edges")
        self.edges = good if self.edges is None else self.edges.unionByName(good)
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        return n

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.tables.append(out)
        return out

    def open_members(self) -> DataFrame | None:
        """Members (band, key, rep, component, n, cells) of the buckets in which several components meet.

        ``cells`` counts, by hash cell, the items of a member that some other open member has too. Items of
        different cells are different, so two members share at most the sum of the smaller counts of all
        cells; members whose counts leave no partner in a bucket are left out of it.
        """
        comps = connected_components(self.edges, "a", "b").withColumnRenamed("node", "rep")
        held = self.members.join(shuffled(comps), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        left = self._mixed(self._keep(held.select("band", "key", "rep", "component"), "components"))
        if left.isEmpty():
            return None
        bags = self.bags.join(shuffled(left.select("rep").distinct()), "rep", "left_semi")
        alone = bags.select("rep", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("df"), F.min("rep").alias("rep")).filter("df = 1")
        alone = alone.groupBy("rep", F.pmod("item", F.lit(CELLS)).cast("int").alias("cell")).agg(F.count("*").cast("int").alias("k"))
        alone = alone.groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("cell", "k"))).alias("alone"))
        none = F.create_map().cast("map<int,int>")
        sizes = bags.join(shuffled(alone), "rep", "left").withColumn("alone", F.coalesce("alone", none))
        shared = F.transform("cells", lambda c, i: c - F.coalesce(F.try_element_at("alone", i), F.lit(0)))
        sizes = sizes.select("rep", F.size("items").alias("n"), shared.alias("cells"))
        sizes = sizes.withColumn("common", F.aggregate("cells", F.lit(0), lambda a, x: a + x))
        left = self._keep(left.join(shuffled(sizes), "rep"), "sizes")
        least = self._keep(left.groupBy("band", "key").agg(F.min("n").alias("least")), "least")
        left = _with_bucket(left, least).filter(self.reachable("n", "least", F.col("common"))).drop("least", "common")
        left = self._mixed(left)
        return None if left.isEmpty() else left

    def open_pairs(self, left: DataFrame) -> DataFrame:
        """Pairs (hub, other) of open members of one bucket and different components that can reach the threshold.

        One of the two is outside the bucket's largest component, so only such members look for partners;
        partners are dealt by size class (sizes further apart than the threshold are in classes further apart
        than one) and, in large buckets, by parts. What cannot reach the threshold is never made a row.
        """
        sizes = left.groupBy("band", "key", "component").agg(F.count("*").alias("size"))
        buckets = sizes.groupBy("band", "key").agg(F.max_by("component", F.struct("size", "component")).alias("major"), F.ceil(F.sum("size") / PART).cast("int").alias("parts"))
        buckets = self._keep(buckets, "buckets")
        # 1e-6 on the side of one class more.
        level = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / self.threshold) * (1 - 1e-6)) if self.threshold < 1 else F.col("n")
        held = self._keep(_with_bucket(left, buckets).withColumn("level", level.cast("long")), "levels")
        minor = held.filter("component <> major").withColumn("level", F.explode(F.array(*[F.col("level") + i for i in (-1, 0, 1)])))
        minor = minor.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p = minor.select("band", "key", "level", "part", F.col("component").alias("x"), F.col("rep").alias("rp"), F.col("n").alias("np"), F.col("cells").alias("cp")).alias("p")
        q = held.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        q = q.select("band", "key", "level", "part", F.col("component").alias("y"), F.col("rep").alias("rq"), F.col("n").alias("nq"), F.col("cells").alias("cq")).alias("q")
        most = F.aggregate(F.zip_with("cp", "cq", lambda u, v: F.least(u, v)), F.lit(0), lambda u, v: u + v)
        meet = (F.col("x") != F.col("y")) & self.reachable("np", "nq", F.least("np", "nq")) & self.reachable("np", "nq", most)
        for c in ("band", "key", "level", "part"):
            meet = (F.col(f"p.{c}") == F.col(f"q.{c}")) & meet
        return p.join(shuffled(q), meet).select(F.col("rq").alias("hub"), F.col("rp").alias("other"))

    def _mixed(self, held: DataFrame) -> DataFrame:
        mixed = held.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size")).filter("x < y and size > 1")
        mixed = self._keep(mixed.select("band", "key"), "mixed")
        return self._keep(_with_bucket(held, mixed), "open")

    def reachable(self, n: str, other: str, common):
        return common / (F.col(n) + F.col(other) - common) >= self.threshold - 1e-9


def _with_bucket(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """``members`` with the columns of their bucket (one row each in ``buckets``): every bucket is met in SALTS parts, so a large one is not one task."""
    salted = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    parts = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(shuffled(parts), ["band", "key", "salt"]).drop("salt")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row of ``documents`` (doc_id, text); the class is its smallest doc_id."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(docs.mapInArrow(_sign, "doc_id long, print binary, n long, bands array<long>"), "signed")
    same = signed.filter("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    same = materialise(same, "same")
    members = materialise(same.groupBy("rep").agg(F.max_by("bands", F.struct("n", "print")).alias("bands")).select("rep", F.posexplode("bands").alias("band", "key")), "members")
    # Only buckets with company matter from here on. The member that meets most others in all its buckets is
    # most likely the text that the others were made from, so it is a bucket's centre.
    sizes = materialise(members.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1"), "sizes")
    shared = materialise(members.join(shuffled(sizes), ["band", "key"]), "shared")
    known = shared.groupBy("rep").agg(F.sum("size").alias("met"))
    met = materialise(shared.drop("size").join(shuffled(known), "rep"), "met")
    centres = materialise(met.groupBy("band", "key").agg(F.max_by("rep", F.struct("met", "rep")).alias("hub")), "centres")
    search = _Search(docs, met, threshold)
    if search.verify(met.join(shuffled(centres), ["band", "key"]).select("hub", F.col("rep").alias("other"))):
        left = search.open_members()
        if left is not None:
            search.verify(search.open_pairs(left))
    classes = same.select("print", "rep")
    if search.edges is not None:
        # A last round may have added links.
        comps = connected_components(search.edges, "a", "b").withColumnRenamed("node", "rep")
        classes = classes.join(shuffled(comps), "rep", "left").select("print", F.coalesce("component", "rep").alias("class_id"))
    else:
        classes = classes.withColumnRenamed("rep", "class_id")
    classes = materialise(classes, "classes")
    discard(same, members, sizes, shared, met, centres, *search.tables)
    found = signed.filter("n > 0 and doc_id is not null").select("doc_id", "print").join(shuffled(classes), "print").select("doc_id", "class_id")
    return found.unionByName(signed.filter("n = 0 or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicate(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One document of each class: the rows of ``documents`` whose doc_id is their class (rows with a null doc_id stay)."""
    others = near_duplicates(documents, threshold).filter("doc_id <> class_id").select("doc_id").distinct()
    return documents.join(shuffled(others), "doc_id", "left_anti")
