"""Evidence collection: chunk seeds, deduplicate by content, verify, score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import scalars as S
from kbspark.functions.text import chunk_text
from kbspark.operators.reasoning import saved


def content_hash(text: Column) -> Column:
    """``sha256:`` and the hex digest of the UTF-8 text; null counts as empty."""
    return S.content_hash(F.coalesce(text, F.lit("")))


def mark_first(docs: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``kept``: whether the row is the first of its key by ``order``; of equal rows exactly one is kept.

    Rows are numbered and written first, so that equal rows stay apart. The first of each key is found by a
    partial aggregate, so a key that holds many rows is not one task. A null key is a key like others.
    """
    docs = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "arrivals")
    first = docs.groupBy(F.col(key).alias("_key")).agg(F.min_by("_row", F.struct(order, "_row")).alias("_first"))
    return docs.join(first, F.col(key).eqNullSafe(F.col("_key"))).withColumn("kept", F.col("_row") == F.col("_first")).drop("_first", "_row", "_key")


def dedup_new(batch: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """``batch`` with ``kept``: not in ``existing`` and first of its key in the batch."""
    known = existing.select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True))
    out = mark_first(batch, key, order).join(known, F.col(key).eqNullSafe(F.col("_key")), "left")
    return out.withColumn("kept", F.col("kept") & F.col("_known").isNull()).drop("_known", "_key")


def chunk_documents(docs: DataFrame, text: str = "text", size: int = 1200, overlap: int = 100) -> DataFrame:
    """One row a chunk: the columns of ``docs`` but the text, chunk_index, chunk_total, chunk."""
    held = docs.withColumn("_chunks", chunk_text(F.col(text), size, overlap)).drop(text)
    return held.withColumn("chunk_total", F.size("_chunks")).select("*", F.posexplode("_chunks").alias("chunk_index", "chunk")).drop("_chunks")


def seeds_of(chunks: DataFrame, retrieved_at: str, tool_version: str = "1", cluster: str | None = None) -> DataFrame:
    """Seed records of chunk rows (uri, title, chunk_index, chunk_total, chunk)."""
    slug = S.uri_slug(F.col("uri"))
    name = F.format_string("%s_%04d", slug, "chunk_index")
    piece = F.struct(
        F.col("chunk_index").alias("index"), F.col("chunk_total").alias("total"), F.lit(0).alias("char_start"),
        F.length("chunk").alias("char_end"), F.substring("chunk", 1, 200).alias("text_preview"),
    )
    return chunks.select(
        F.concat(F.lit("evidence:seed:"), name).alias("id"), S.uri_kind(F.col("uri")).alias("kind"), "uri", F.lit(retrieved_at).alias("retrieved_at"),
        content_hash(F.col("chunk")).alias("content_hash"), "title", piece.alias("chunk"), F.array().cast("array<string>").alias("claims"), F.lit("collected").alias("status"),
        F.lit(cluster).cast("string").alias("cluster_hint"), F.concat(F.lit("evidence/md/"), name, F.lit(".md")).alias("md_path"), F.lit(tool_version).alias("tool_version"), F.col("chunk").alias("text"),
    )


def collect(pages: DataFrame, existing: DataFrame, retrieved_at: str, size: int = 1200, overlap: int = 100) -> DataFrame:
    """Fetched pages (ordinal, uri, content_type, body) to seeds with ``kept``; one plan deduplicates over all sources."""
    html = S.is_html(F.col("content_type"), F.col("body"))
    page = F.when(html, S.html_extract(F.col("body")))
    docs = pages.select("ordinal", "uri", F.when(html, page["text"]).otherwise(S.strip_frontmatter(F.col("body"))).alias("text"), F.coalesce(page["title"], F.lit("")).alias("title"))
    chunks = chunk_documents(docs, "text", size, overlap)
    order = F.struct("ordinal", "chunk_index")
    seeds = seeds_of(chunks, retrieved_at).withColumn("_at", F.col("chunk.index"))
    ranked = chunks.select("uri", "chunk_index", order.alias("arrival"))
    seeds = seeds.join(ranked, (seeds["uri"] == ranked["uri"]) & (F.col("_at") == F.col("chunk_index"))).drop(ranked["uri"]).drop("_at", "chunk_index")
    return dedup_new(seeds, existing, "content_hash", "arrival")


def source_diversity(documents: DataFrame, low: int = 300, high: int = 1200) -> DataFrame:
    """Per source: rows, first arrivals, repeats, languages, share kept, and whether the mean length is in bounds."""
    docs = documents.select("doc_id", "source", "lang", F.length(F.coalesce("text", F.lit(""))).alias("n"), content_hash(F.col("text")).alias("h"))
    kept = F.count_if("kept")
    return (
        mark_first(docs, "h", "doc_id")
        .groupBy("source")
        .agg(
            F.count("*").alias("total"), kept.alias("kept"), F.count_if(~F.col("kept")).alias("skipped"), F.countDistinct("lang").alias("languages"),
            F.bround(kept / F.count("*"), 3).alias("kept_share"), F.avg("n").between(low, high).alias("length_ok"),
        )
    )


def seed_violations(seeds: DataFrame) -> DataFrame:
    """(id, rule) for each broken rule of a seed: required fields, id and hash patterns, chunk fields."""
    required = ["id", "kind", "uri", "retrieved_at", "content_hash", "title", "md_path", "tool_version"]
    rules = [F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(f"missing:{c}")) for c in required]
    rules += [F.when(F.col("chunk").isNull() | F.col(f"chunk.{c}").isNull(), F.lit(f"missing:chunk.{c}")) for c in ("index", "total", "char_start", "char_end")]
    rules.append(F.when(~F.col("id").rlike(r"^evidence:seed:[a-z0-9_]+$"), F.lit("pattern:id")))
    rules.append(F.when(~F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit("pattern:content_hash")))
    every = F.filter(F.array(*rules), lambda r: r.isNotNull())
    repeated = seeds.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate:id").alias("rule"))
    return seeds.select("id", F.explode(every).alias("rule")).unionByName(repeated)


def missing_notes(records: DataFrame, files: DataFrame, path: str = "md_path") -> DataFrame:
    """Records whose note path is empty or not among ``files`` (path)."""
    absent = records.filter(F.col(path).isNotNull() & (F.col(path) != "")).join(files.select(F.col("path").alias(path)).distinct(), path, "left_anti")
    return absent.unionByName(records.filter(F.col(path).isNull() | (F.col(path) == "")))


def readiness(seeds: DataFrame, files: DataFrame, size: int = 1200) -> DataFrame:
    """One row: uniqueness, length_ok, hashes_ok, notes, score (mean of the four, each rounded first); zeros without seeds."""
    length = F.col("chunk.char_end") - F.col("chunk.char_start")
    length = F.when(length > 0, length).otherwise(F.length(F.coalesce("chunk.text_preview", F.lit(""))))
    have = files.select(F.col("path").alias("md_path"), F.lit(1).alias("_have")).distinct()
    one = seeds.join(have, "md_path", "left").agg(
        F.bround(F.coalesce(F.try_divide(F.countDistinct("uri"), F.count("*")), F.lit(0.0)), 3).alias("uniqueness"),
        F.when(F.avg(length).between(300, size), 1.0).otherwise(0.0).alias("length_ok"),
        F.when(F.bool_and(F.coalesce(F.col("content_hash").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))), 1.0).otherwise(0.0).alias("hashes_ok"),
        F.bround(F.coalesce(F.avg(F.coalesce("_have", F.lit(0)).cast("double")), F.lit(0.0)), 3).alias("notes"),
    )
    return one.withColumn("score", F.bround((F.col("uniqueness") + F.col("length_ok") + F.col("hashes_ok") + F.col("notes")) / 4, 3))


def chunk_overlap_window(pieces: DataFrame, doc: str, at: str, piece: str, overlap: int) -> DataFrame:
    """Forward overlap as a window: each piece with the head of the next one of its document."""
    following = F.lead(piece).over(Window.partitionBy(doc).orderBy(at))
    return pieces.withColumn("overlapped", F.when(following.isNull(), F.col(piece)).otherwise(F.concat(F.col(piece), F.lit(" "), F.substring(following, 1, overlap))))
