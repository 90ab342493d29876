"""Chunking of texts with higher-order functions only: nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.functions.scalars import strip

MIN_CHUNK = 300


def _array(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def paragraphs(text: Column) -> Column:
    """Stripped, non-empty paragraphs; a paragraph ends at an empty line."""
    parts = F.transform(F.split(strip(text), r"\n\n+"), strip)
    return F.filter(parts, lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Split after ``.``, ``?`` or ``!`` at white space."""
    return F.filter(F.transform(F.split(paragraph, r"(?U)(?<=[.?!])\s+"), strip), lambda s: s != "")


def windows(text: Column, size: int, overlap: int) -> Column:
    """Sliding windows; one if the text fits, else as many as cover it."""
    step = max(1, size - overlap)
    n = F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pack(items: Column, fits, joined) -> Column:
    """Fold items into buffers: while ``fits(buffer, item)`` the item joins the buffer, else a new one begins."""
    zero = F.struct(_array().alias("done"), F.lit(None).cast("string").alias("buf"))

    def step(acc: Column, item: Column) -> Column:
        first, more = acc["buf"].isNull(), fits(acc["buf"], item)
        done = F.when(first | more, acc["done"]).otherwise(F.concat(acc["done"], _array(acc["buf"])))
        buf = F.when(first, item).when(more, joined(acc["buf"], item)).otherwise(item)
        return F.struct(done.alias("done"), buf.alias("buf"))

    return F.aggregate(items, zero, step, lambda acc: F.when(acc["buf"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], _array(acc["buf"]))))


def pack_sentences(parts: Column, size: int) -> Column:
    """Sentences (an array) packed while they fit in ``size``; a longer sentence stays whole."""
    return _pack(parts, lambda b, s: F.length(b) + 1 + F.length(s) <= size, lambda b, s: F.concat(b, F.lit(" "), s))


def merge_short(pieces: Column, least: int = MIN_CHUNK) -> Column:
    """Pieces joined while what is gathered is shorter than ``least``; the last may stay short."""
    return _pack(pieces, lambda b, p: F.length(b) < least, lambda b, p: F.concat(b, F.lit(" "), p))


def forward_overlap(pieces: Column, overlap: int) -> Column:
    """Each piece with the first characters of the next."""
    if overlap <= 0:
        return pieces
    joined = lambda p, q: F.when(q.isNull(), p).otherwise(F.concat(p, F.lit(" "), F.substring(q, 1, overlap)))
    return _let(pieces, lambda ps: F.zip_with(ps, F.slice(ps, 2, F.size(ps) + 1), joined))


def chunk_text(text: Column, size: int = 1200, overlap: int = 100, least: int = MIN_CHUNK) -> Column:
    """array<string>: paragraphs, cut by sentences or windows where too long, short ones merged, overlapped forward."""

    def cut(p: Column) -> Column:
        long = _let(sentences(p), lambda parts: F.when(F.size(parts) > 1, pack_sentences(parts, size)).otherwise(windows(p, size, overlap)))
        return F.when(F.length(p) <= size, _array(p)).otherwise(long)

    return forward_overlap(merge_short(F.flatten(F.transform(paragraphs(F.coalesce(text, F.lit(""))), cut)), least), overlap)
