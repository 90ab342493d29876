"""The library's functions for SQL: temporary functions and table functions of a session.

Scalar functions are SQL expressions that Spark puts into the query's plan; only what parses HTML or YAML, and
the table function of chunks, run in Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.functions.text import MIN_CHUNK

#: Argument type, result type and column function of each scalar function of one argument ``v``.
SCALARS = {
    "kb_strip": ("STRING", "STRING", S.strip),
    "kb_content_hash": ("STRING", "STRING", S.content_hash),
    "kb_short_id": ("STRING", "STRING", S.short_id),
    "kb_graph_slug": ("STRING", "STRING", S.graph_slug),
    "kb_snake": ("STRING", "STRING", S.registry_snake),
    "kb_uri_slug": ("STRING", "STRING", S.uri_slug),
    "kb_round": ("DOUBLE", "DOUBLE", lambda c: F.bround(c, 3)),
}


def chunks_of(text: str | None, size: int = 1200, overlap: int = 100, least: int = MIN_CHUNK) -> list[str]:
    """The chunks of one text in plain Python, equal to ``chunk_text``."""
    pieces: list[str] = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\n+", (text or "").strip()))):
        parts = [s for s in (s.strip() for s in re.split(r"(?<=[.?!])\s+", paragraph)) if s]
        if len(paragraph) <= size:
            pieces.append(paragraph)
        elif len(parts) < 2:
            step = max(1, size - overlap)
            pieces += [paragraph[at : at + size] for at in range(0, max(1, len(paragraph) - size + step), step)]
        else:
            pieces += _gathered(parts, lambda held, s: len(held) + 1 + len(s) <= size)
    merged = _gathered(pieces, lambda held, _: len(held) < least)
    return [p + " " + q[:overlap] if overlap > 0 and q is not None else p for p, q in zip(merged, [*merged[1:], None])]


def _gathered(items: list[str], fits) -> list[str]:
    out: list[str] = []
    for item in items:
        if out and fits(out[-1], item):
            out[-1] += " " + item
        else:
            out.append(item)
    return out


class _Chunks:
    def eval(self, text: str, size: int, overlap: int):
        yield from enumerate(chunks_of(text, size, overlap))


def _html(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([S.parse_html(h) for h in html], columns=["title", "text"])


def register(spark: SparkSession) -> list[str]:
    """Registers the scalar functions above, ``kb_html(html)``, ``kb_frontmatter(text)`` and the table function ``kb_chunks(text, size, overlap)``; returns all names."""
    from kbspark.sources.files import _NOTE, _frontmatters

    for name, (given, kind, function) in SCALARS.items():
        plan = spark.createDataFrame([], f"v {given}").select(function(F.col("v")))._jdf.queryExecution().analyzed()
        expression = plan.expressions().apply(0)
        sql = (expression.child() if expression.nodeName() == "Alias" else expression).sql()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v {given}) RETURNS {kind} RETURN {sql}")
    spark.udf.register("kb_html", F.pandas_udf(_html, "struct<title:string,text:string>"))
    spark.udf.register("kb_frontmatter", F.pandas_udf(_frontmatters, f"struct<{', '.join(f.replace(' ', ':', 1) for f in _NOTE.split(', '))}>"))
    spark.udtf.register("kb_chunks", F.udtf(_Chunks, returnType="chunk_index int, chunk string"))
    return [*SCALARS, "kb_html", "kb_frontmatter", "kb_chunks"]
