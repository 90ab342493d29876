"""Operator 5: exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are integers (the floor of ``scale`` times each component). An index shard keeps a posting for each
non-zero component; postings of one dimension and one impact (the integer itself) form a segment, and the
segments of a shard are processed by descending absolute impact, for a block of queries at once. What is
not processed yet is bounded by Cauchy-Schwarz: |query| times the norm of each row's unprocessed part. Work
on a shard stops only when that bound proves for every query which rows can still be among its k best;
those rows are then scored exactly.

Rows are dealt into shards by classes of descending norm, and shards in turn to GROUPS groups. A task meets one block of
queries with one group, shard by shard, and keeps the k best so far: a query's k-th score is the bar for the
next shard, and a shard whose largest norm cannot reach any query's bar is passed over, which proves its rows
out. So every query meets every shard, and hands on at most GROUPS * k rows however many rows are indexed.

Defined cases: vectors that are null, or hold a null or non-finite component, and rows with a null vec_id take
no part; an empty vector scores 0 with all; a shorter vector counts as padded with zeros; rows of equal vec_id
are rows of their own, as candidates and as queries (a query leaves out its own row only, and each of its rows
has its own ranks); ties go to the smaller vec_id; a component whose floor or a score that is outside a long
counts as the nearest long; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.llm.common import materialise, small_batches

SHARD_ROWS, QUERY_ROWS, GROUPS, CLASSES = 2048, 512, 8, 16
#: Bounds are tried each time the postings left are at most this share, halved at every try.
FIRST_TRY = 0.4
#: A shard is rescored once at most this share of (row, query) pairs is still possible.
RESCORE = 0.05


def quantised(embedding: Column, scale: int = 64) -> Column:
    """array<long> of floor(scale * x), x as double; null if a component is null or non-finite."""
    d = F.transform(embedding, lambda x: x.cast("double"))
    good = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(d, lambda x: F.floor(x * float(scale))))


def _matrix(codes: list) -> np.ndarray:
    width = max(map(len, codes), default=0)
    out = np.zeros((len(codes), width), dtype=np.int64)
    for i, c in enumerate(codes):
        out[i, : len(c)] = c
    return out


def build_segments(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, rows): each segment is (impact, dimension, first, end) into ``rows``, by descending absolute impact."""
    row, dim = np.nonzero(codes)
    value = codes[row, dim]
    order = np.lexsort((row, dim, value, -np.abs(value.astype(np.float64))))
    row, dim, value = row[order], dim[order], value[order]
    first = np.flatnonzero(np.r_[True, (np.diff(value) != 0) | (np.diff(dim) != 0)]) if len(row) else np.zeros(0, dtype=np.int64)
    end = np.r_[first[1:], len(row)] if len(row) else first
    return np.stack([value[first], dim[first], first, end], axis=1) if len(row) else np.zeros((0, 4), dtype=np.int64), row.astype(np.int32)


_LEAST, _MOST = -(2**63), 2**63 - 1


def search_shard(ids, rows_of, codes, segments, rows, query_rows, queries, k: int, bar=None):
    """(query position, row position, score) of each query's k best rows of the shard, its own row left out.

    ``ids`` and ``rows_of``: vec_id and row number of the shard's rows; ``bar``: scores that only rows at or
    above them still matter for, one a query.
    """
    n, b = len(ids), len(query_rows)
    width = max(codes.shape[1], queries.shape[1])
    codes, queries = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (codes, queries))
    wide = codes.astype(np.float64)
    most = float(np.abs(wide).max(initial=0)) * float(np.abs(queries.astype(np.float64)).max(initial=0)) * max(width, 1)
    exact = object if most >= 2**62 else np.int64
    small = np.float64 if exact is object else np.int32 if most < 2**31 else np.int64
    acc = np.zeros((n, b), dtype=small)
    by_dim = np.ascontiguousarray(queries.T.astype(small))
    left = (wide**2).sum(axis=1)
    norm = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    own = rows_of[:, None] == query_rows[None, :]
    bar = np.full(b, -np.inf) if bar is None else bar
    total, done, share, possible = len(rows), 0, FIRST_TRY, None
    sizes = np.abs(segments[:, 0].astype(np.float64))
    # Sums of floats stray by less than this share of the largest sum.
    stray = most * 1e-9 if exact is object else 0.0
    for at, (impact, dim, first, end) in enumerate(segments.tolist()):
        hit = rows[first:end]
        acc[hit] += by_dim[dim] * small(impact)
        left[hit] -= float(impact) ** 2
        done += end - first
        if total - done <= share * total and (at + 1 == len(segments) or sizes[at + 1] != sizes[at]):
            # Proof: with what is unprocessed, no other row can reach the k-th best lower bound.
            slack = np.sqrt(np.maximum(left, 0))[:, None] * norm[None, :] * (1 + 1e-9) + stray + (left > 0)[:, None] * 1e-3
            kth = bar
            if n > k and not np.isfinite(bar).all():
                low = np.clip(np.where(own, -np.inf, acc.astype(np.float64) - slack), -np.inf, 2.0**63)
                kth = np.maximum(bar, np.partition(low, n - k, axis=0)[n - k])
            high = np.clip(acc.astype(np.float64) + slack, -(2.0**63), 2.0**63)
            possible = (high * (1 + 1e-12 * np.sign(high)) >= kth[None, :]) & ~own
            if possible.sum() <= max(RESCORE * n * b, 2 * k * b):
                break
            share = share / 2
    if possible is None:
        possible = ~own
    row, query = np.nonzero(possible)
    score = np.empty(len(row), dtype=np.int64)
    for a in range(0, len(row), 200_000):
        r, q = row[a : a + 200_000], query[a : a + 200_000]
        if exact is object:
            score[a : a + 200_000] = [min(max(int(x), _LEAST), _MOST) for x in (codes[r].astype(object) * queries[q].astype(object)).sum(axis=1)]
        else:
            score[a : a + 200_000] = np.einsum("ij,ij->i", codes[r], queries[q])
    return best_of(query, row, ids[row], score, b, k)


def best_of(query, row, ids, score, b: int, k: int):
    """Each query's k best of (query, row, vec_id, score), by descending score, then vec_id."""
    order = np.lexsort((ids, ~score, query))
    query, row, score = query[order], row[order], score[order]
    start = np.searchsorted(query, np.arange(b))
    keep = np.arange(len(query)) - start[query] < k
    return query[keep], row[keep], score[keep]


_INDEX = "kind int, part int, norm double, width int, ids binary, numbers binary, codes binary, segments binary, rows binary"
_INDEX_ARROW = pa.schema(
    [("kind", pa.int32()), ("part", pa.int32()), ("norm", pa.float64()), ("width", pa.int32()), *((c, pa.binary()) for c in ("ids", "numbers", "codes", "segments", "rows"))]
)


def _pack(kind: int):
    """The rows of one part as one record; shards (kind 1) with their segments."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = sorted(zip(*(table.column(c).to_pylist() for c in ("row", "vec_id", "codes"))), key=lambda x: x[0])
        matrix = _matrix([c for _, _, c in held])
        norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        segments, rows = build_segments(matrix) if kind else (np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int32))
        numbers, ids = (np.asarray([x[i] for x in held], dtype=np.int64).tobytes() for i in (0, 1))
        values = (kind, table.column("part")[0].as_py(), norm, matrix.shape[1], ids, numbers, _narrow(matrix), segments.astype(np.int64).tobytes(), rows.tobytes())
        return pa.Table.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _INDEX_ARROW)], schema=_INDEX_ARROW)

    return run


def _narrow(matrix: np.ndarray) -> bytes:
    fits = len(matrix) == 0 or (matrix.max(initial=0) < 2**15 and matrix.min(initial=0) >= -(2**15))
    return (b"\2" if fits else b"\x08") + matrix.astype("<i2" if fits else "<i8").tobytes()


def _wide(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw[1:], dtype="<i2" if raw[:1] == b"\2" else "<i8").astype(np.int64).reshape(n, width)


_FOUND = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(k: int):
    """Units come one after the other: a block of queries, then the shards of a group by descending norm."""

    def run(batches):
        block = best = None
        for batch in batches:
            for r in range(batch.num_rows):
                x = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, numbers = (np.frombuffer(x[c], dtype=np.int64) for c in ("ids", "numbers"))
                codes = _wide(x["codes"], x["width"], len(ids))
                if x["kind"] == 0:
                    if block is not None:
                        yield found(block, best)
                    none = np.zeros(0, dtype=np.int64)
                    block, best = (ids, numbers, codes, np.sqrt((codes.astype(np.float64) ** 2).sum(axis=1))), (none, none, none)
                    continue
                b = len(block[0])
                full = np.bincount(best[0], minlength=b) >= k
                bar = np.full(b, -np.inf)
                np.minimum.at(low := np.full(b, np.inf), best[0], best[2].astype(np.float64))
                bar[full] = low[full] - np.abs(low[full]) * 1e-12
                if (block[3] * x["norm"] * (1 + 1e-9) < bar).all():
                    continue
                segments = np.frombuffer(x["segments"], dtype=np.int64).reshape(-1, 4)
                q, row, score = search_shard(ids, numbers, codes, segments, np.frombuffer(x["rows"], dtype=np.int32), block[1], block[2], k, bar)
                q, names, score = np.append(best[0], q), np.append(best[1], ids[row]), np.append(best[2], score)
                best = best_of(q, names, names, score, b, k)
        if block is not None:
            yield found(block, best)

    def found(block, best):
        q, names, score = best
        return pa.RecordBatch.from_arrays([pa.array(block[1][q]), pa.array(block[0][q]), pa.array(names), pa.array(score)], schema=_FOUND)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row of ``vectors`` (vec_id, embedding) that ``queries`` picks by vec_id."""
    small_batches(vectors.sparkSession)
    codes = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("codes"))
    codes = materialise(codes.filter("vec_id is not null and codes is not null").withColumn("row", F.monotonically_increasing_id()), "codes")
    square = F.aggregate("codes", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    # Classes of norm, of about equally many rows; a class is dealt by hash into shards of about SHARD_ROWS rows.
    edges = codes.agg(F.percentile_approx(square, [i / CLASSES for i in range(CLASSES - 1, 0, -1)], F.lit(10_000)).alias("e")).first().e or []
    own = sum((F.when(square < e, 1).otherwise(0) for e in edges), F.lit(0))
    sizes = {r.c: (r.n, r.q) for r in codes.groupBy(own.alias("c")).agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).collect()}
    shards = [-(-sizes.get(c, (0, 0))[0] // SHARD_ROWS) for c in range(CLASSES)]
    blocks = max(1, -(-sum(q for _, q in sizes.values()) // QUERY_ROWS))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), own + 1)
    part = pick([sum(shards[:c]) for c in range(CLASSES)]) + F.pmod(F.xxhash64("row"), pick([max(1, s) for s in shards]))
    index = materialise(codes.withColumn("part", part.cast("int")).groupBy("part").applyInArrow(_pack(1), _INDEX), "index")
    asked = codes.filter(queries).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    asked = materialise(asked.groupBy("part").applyInArrow(_pack(0), _INDEX).withColumn("unit", F.col("part")), "blocks")
    # Units: every block of queries with every group of shards; the block itself goes first. One row a shard or block.
    groups = index.withColumn("group", F.pmod("part", F.lit(GROUPS)))
    every = F.explode(F.sequence(F.lit(0), F.lit(GROUPS - 1)))
    columns = [f.name for f in _INDEX_ARROW]
    names = asked.select("unit").withColumn("group", every)
    shard_units = names.join(groups, "group").select("unit", "group", *columns)
    units = asked.withColumn("group", every).select("unit", "group", *columns).unionByName(shard_units)
    n_units = blocks * GROUPS
    units = units.repartition(n_units, "unit", "group").sortWithinPartitions("unit", "group", "kind", F.desc("norm"))
    found = units.select(*columns).mapInArrow(_search(k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return out


ORACLE = """
with v as (select vec_id, row_number() over () as r, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as codes from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, q.r, c.vec_id, list_sum(list_transform(list_zip(q.codes, c.codes), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint as score
           from v q join v c on q.r <> c.r where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by r order by score desc, vec_id)::int as rank, vec_id, coalesce(score, 0) as score
from scored qualify rank <= 20
"""
