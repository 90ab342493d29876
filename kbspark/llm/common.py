"""Helpers shared by the training-data operators: shared-folder tables, batching and hashing."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a single machine (``local`` masters: tests) a temporary folder is made and
    set; a cluster without the setting is refused, since its executors could not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="kbspark-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound Arrow batches by bytes where the session has Spark's default (64 MB, held several times over by both sides)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") in ("67108864b", "64m", "64MB"):
        spark.conf.set(key, size)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``materialise`` that nothing will read again; other frames are left alone."""
    for table in tables:
        path = table.__dict__.pop("_written_at", None) if table is not None else None
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: what grows with the documents does not pass the driver, however small its files are."""
    return df.hint("merge")


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches, column: str, rows: int = 2000, size: int = 8_000_000):
    """Cut Arrow batches so that no slice has more than ``rows`` rows or about ``size`` bytes of ``column`` (or ``struct.field``)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        lens = np.asarray([0 if x is None else x for x in _lengths(pick(batch, column))])
        ends = np.cumsum(lens)
        while at < n:
            base = ends[at - 1] if at else 0
            to = min(n, at + rows, max(at + 1, int(np.searchsorted(ends, base + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to
        release()


@functools.cache
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


def release() -> None:
    """Give memory that this worker has freed back to the system: workers live on between stages."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def pick(batch: pa.RecordBatch, column: str):
    """A column, or a field of a struct column."""
    name, _, field = column.partition(".")
    found = batch.column(batch.schema.get_field_index(name))
    return found.field(field) if field else found


def _lengths(column) -> list:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


def to_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M1
        x = (x ^ (x >> np.uint64(27))) * M2
        return x ^ (x >> np.uint64(31))


_GOLD = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ordered, disjoint spans of ``codes``: the sum of mixed (code, place in the span), mixed with the length."""
    n = end - start
    with np.errstate(over="ignore"):
        place = np.arange(len(codes), dtype=np.uint64)
        place -= np.repeat(start.astype(np.uint64), np.diff(np.append(start, len(codes)))) if len(start) and start[0] == 0 else _origins(start, len(codes))
        mixed = mix64((place << np.uint64(21)) + codes.astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        return mix64(sums[end] - sums[start] + n.astype(np.uint64) * _GOLD)


def _origins(start: np.ndarray, n: int) -> np.ndarray:
    """For each place the start of the span that it is in or behind (0 before the first)."""
    return np.repeat(np.append(0, start).astype(np.uint64), np.diff(np.concatenate([[0], start, [n]])))
