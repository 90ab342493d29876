"""Operator 11: line deduplication over all documents, as compressed keep bitmaps.

A line's key is the line without white space at its ends and with A-Z in lower case. Keys of at least
``least_chars`` code points that at least ``least_docs`` documents hold lose all their lines but those of the
largest doc_id that holds them.

Lines travel as two 64-bit hashes of their keys, never as text. Rows (hash, doc_id, line number) are dealt by
ranges of all three and sorted by hash, then document from the largest down, then place: a key that a third
of all lines share is spread over as many ranges as its rows fill. A task streams its range once and decides
every run of one hash that lies inside; runs that touch an end of the range may go on next door, so their rows
leave undecided and are settled by (largest document, number of documents) of at most two hashes a range. What
is returned is a zlib-compressed bitmap for each document that loses lines; texts meet it in one join.

Defined cases: a null or empty text is one empty line; rows with one doc_id are one document, and those with
equal texts lose the same lines; a null doc_id is a document smaller than every other; extra columns, whatever
their names, are ignored; no rows give no rows. Keys are told apart by 128 bits of hash.
"""

from __future__ import annotations

import string
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kbspark.llm.common import discard, materialise, small_batches, to_batch

LEAST_CHARS, LEAST_DOCS = 40, 5
#: What is stripped from both ends of a line.
STRIPPED = " \t\n\x0b\x0c\r"
#: A row's state: its line goes; undecided; only says that a document holds the hash.
DROP, OPEN, SEEN = 0, 1, 2

_STREAM = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("print", pa.int64()), ("place", pa.int32()), ("state", pa.int8())])


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc, print, text): what a document's rows are known by, and its text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))


def long_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h1, h2, doc, print, place) of every line whose key has at least ``least_chars`` code points."""
    lines = _rows(docs).select("doc", "print", F.posexplode(F.split("text", "\n", -1)).alias("place", "line")).filter(F.length("line") >= least_chars)
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= least_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "print", "place")


def _first_occurrences(least_docs: int):
    """Stream sorted rows: decide the runs inside, hand on those at both ends of the range."""

    def run(batches):
        names = _STREAM.names[:5]
        held, opening, decided, docs = None, True, False, []

        def out(rows: list[np.ndarray], state: int | np.ndarray):
            states = np.broadcast_to(np.asarray(state, dtype=np.int8), len(rows[0]))
            return to_batch(dict(zip(_STREAM.names, [*rows, states])), _STREAM)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            if held is not None and (rows[0][0], rows[1][0]) == key:
                # The run that was last goes on: with its fate known only the new rows are looked at.
                stop = np.flatnonzero((rows[0] != key[0]) | (rows[1] != key[1]))
                stop = int(stop[0]) if len(stop) else len(rows[0])
                more, rows = [r[:stop] for r in rows], [r[stop:] for r in rows]
                docs = _distinct(docs, more[2], least_docs)
                if opening:
                    yield out(more, OPEN)
                elif decided:
                    yield out(more, DROP)
                else:
                    held = [np.concatenate(x) for x in zip(held, more)]
                    if len(docs) >= least_docs:
                        gone = held[2] != docs[0]
                        yield out([r[gone] for r in held], DROP)
                        decided, held = True, [r[:0] for r in held]
                if not len(rows[0]):
                    continue
            # What was held ends here; it never reached enough documents, or is settled elsewhere.
            begins = np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
            last = int(begins[-1])
            first_run = 0
            if held is None and len(begins) > 1:
                yield out([r[: begins[1]] for r in rows], OPEN)
                first_run = int(begins[1])
            opening = held is None and len(begins) == 1
            inner = [r[first_run:last] for r in rows]
            if len(inner[0]):
                gone = _gone(*inner[:3], least_docs)
                if gone.any():
                    yield out([r[gone] for r in inner], DROP)
            held, key = [r[last:] for r in rows], (rows[0][last], rows[1][last])
            docs, decided = _distinct([], held[2], least_docs), False
            if opening:
                yield out(held, OPEN)
                held = [r[:0] for r in held]
            elif len(docs) >= least_docs:
                gone = held[2] != docs[0]
                yield out([r[gone] for r in held], DROP)
                decided, held = True, [r[:0] for r in held]
        if held is None or opening:
            return
        if not decided:
            yield out(held, OPEN)
        else:
            # The next range needs to know the largest document and that there are enough.
            n = len(docs)
            full = [np.full(n, key[0]), np.full(n, key[1]), np.asarray(docs, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int32)]
            yield out(full, SEEN)

    return run


def _distinct(known: list[int], docs: np.ndarray, most: int) -> list[int]:
    """``known`` with the next different values of the sorted ``docs``, ``most`` at most."""
    if len(known) >= most or not len(docs):
        return known
    fresh = docs[np.append(True, docs[1:] != docs[:-1])][: most + 1].tolist()
    return [*known, *(d for d in fresh if not known or d != known[-1])][:most]


def _gone(h1: np.ndarray, h2: np.ndarray, doc: np.ndarray, least_docs: int) -> np.ndarray:
    """Which rows of complete runs are in a run of enough documents and not of its first document."""
    begin = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
    at = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    turns = begin | np.append(True, doc[1:] != doc[:-1])
    return (np.add.reduceat(turns.astype(np.int64), at) >= least_docs)[run] & (doc != doc[at][run])


def dropped_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, print, place) of every line that goes, once each."""
    small_batches(docs.sparkSession)
    lines = materialise(long_lines(docs, least_chars), "lines")
    order = ["h1", "h2", F.col("doc").desc(), "print", "place"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = materialise(dealt.mapInArrow(_first_occurrences(least_docs), "h1 long, h2 long, doc long, print long, place int, state byte"), "dropped")
    discard(lines)
    ends = streamed.filter(F.col("state") != DROP)
    # At most two hashes a range: a table whose size the number of partitions bounds.
    found = ends.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.max("doc").alias("keeper"), F.count("*").alias("n")).filter(F.col("n") >= least_docs)
    settled = ends.filter(F.col("state") == OPEN).join(F.broadcast(found), ["h1", "h2"]).filter(F.col("doc") != F.col("keeper"))
    return streamed.filter(F.col("state") == DROP).select("doc", "print", "place").unionByName(settled.select("doc", "print", "place")).distinct()


def _bitmaps(batches):
    schema = pa.schema([("doc", pa.int64()), ("print", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
    for batch in batches:
        doc, mark, places = (batch.column(batch.schema.get_field_index(n)) for n in ("doc", "print", "places"))
        values, ends = places.flatten().to_numpy(zero_copy_only=False), places.offsets.to_numpy(zero_copy_only=False)
        ends, keep = ends - ends[0], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            bits = np.ones(8 * (int(values[a:b].max()) // 8 + 1), dtype=bool)
            bits[values[a:b]] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield to_batch({"doc": doc, "print": mark, "n_dropped": np.diff(ends).astype(np.int64), "keep": keep}, schema)


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc, print, n_dropped, keep) for each document text that loses lines; texts without a row keep all of theirs.

    ``keep``: zlib frame of one bit a line, from the highest of each byte, up to the byte of the last line that
    goes; the lines behind it stay. ``print`` tells texts of one doc_id apart.
    """
    per = dropped_lines(docs, least_chars, least_docs).groupBy("doc", "print").agg(F.collect_list("place").alias("places"))
    return per.mapInArrow(_bitmaps, "doc long, print long, n_dropped long, keep binary")


def kept_text(text: str, keep: bytes) -> str:
    """``text`` with the lines that its bitmap keeps."""
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)]
    return "\n".join([x for x, k in zip(lines, bits.tolist()) if k] + lines[len(bits) :])


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else kept_text(t, k) for t, k in zip(text, keep)], dtype=object)


def deduplicated(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, keep) of every document, with the text that stays."""
    rows = _rows(docs)
    # The bitmaps are the small side of every partition; a text that many rows repeat is a skewed left side, which Spark splits.
    met = rows.join(keep_bitmaps(docs, least_chars, least_docs).hint("shuffle_hash"), ["doc", "print"], "left")
    touched = F.when(F.col("keep").isNotNull(), F.col("text"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + F.lit(1)
    return met.select("doc_id", F.coalesce(_kept(touched, F.col("keep")), F.col("text")).alias("text"), lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"), "keep")


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    out = deduplicated(docs, least_chars, least_docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


_CHARS = " || ".join(f"chr({ord(c)})" for c in STRIPPED)
ORACLE = f"""
with given as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
     each as (select r, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from given),
     keyed as (select *, translate(trim(line, {_CHARS}), '{string.ascii_uppercase}', '{string.ascii_lowercase}') as key from each),
     shared as (select key, max(doc_id) as keeper from keyed where length(key) >= {LEAST_CHARS} group by key having count(distinct doc_id) >= {LEAST_DOCS}),
     fate as (select r, k.doc_id, line, place, keeper is not null and k.doc_id <> keeper as gone from keyed k left join shared s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (not gone), '')) as kept_sha256
from fate group by r, doc_id"""
