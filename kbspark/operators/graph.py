"""Graph search, vectors, rank fusion, roll-up along relations, composition of typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.reasoning import saved


def hops(edges: DataFrame, seeds: DataFrame, most: int = 3, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, hop): nodes within ``most`` hops of the seeds (node), with the smallest number of hops."""
    edges = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    front = seen = saved(seeds.select("node").distinct().withColumn("hop", F.lit(0)), "hops")
    for hop in range(1, most + 1):
        fresh = front.join(edges, "node").select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        front = saved(fresh.withColumn("hop", F.lit(hop)), "hops")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int | None = None) -> DataFrame:
    """(src, dst): all pairs joined by a path; cycles are fine."""
    from kbspark.operators.reasoning import Rules, close_properties

    props = edges.select(F.col(src).alias("x"), F.lit("e").alias("p"), F.col(dst).alias("y"))
    return close_properties(props, Rules(transitive=["e"]), rounds).select(F.col("x").alias(src), F.col("y").alias(dst))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score, rank) of the k vectors nearest to one query; a take-ordered, no global sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    scored = vectors.select(id_, F.try_divide(dot(F.col(vector), q), norm(F.col(vector)) * norm(q)).alias("score"))
    top = scored.orderBy(F.desc("score"), id_).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_)))


def fuse_ranks(rankings: list[DataFrame], id_: str, k: int = 60) -> DataFrame:
    """(id, fused): reciprocal-rank fusion, the sum of 1 / (k + rank)."""
    out = rankings[0].select(id_, "rank")
    for r in rankings[1:]:
        out = out.unionByName(r.select(id_, "rank"))
    return out.groupBy(id_).agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"))


def rollup_sum(children: DataFrame, parent: str, value: str) -> DataFrame:
    return children.groupBy(parent).agg(F.sum(value).alias("total"))


def rollup_weighted(children: DataFrame, parent: str, value: str, weight: str) -> DataFrame:
    return children.groupBy(parent).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


#: Composition of morphisms, row first.
KINDS = ("causes", "requires", "constrains", "informs")
COMPOSITION = {
    "causes": ("causes", "causes", "causes", "informs"),
    "requires": ("requires", "requires", "constrains", "requires"),
    "constrains": ("constrains", "constrains", "constrains", "constrains"),
    "informs": ("informs", "informs", "informs", "informs"),
}


def compose_edges(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(src, dst, kind, via, hops): edges composed over two or three hops by the table; kinds outside it take no part."""
    spark = edges.sparkSession
    table = spark.createDataFrame([(a, b, c) for a, row in COMPOSITION.items() for b, c in zip(KINDS, row)], "k1 string, k2 string, kind string")
    base = edges.filter(F.col("kind").isin(*KINDS)).select("src", "dst", "kind").distinct()
    second = base.select(F.col("src").alias("via"), F.col("dst").alias("end"), F.col("kind").alias("k2"))
    out, now = None, base.withColumnRenamed("kind", "k1")
    for n in range(2, rounds + 2):
        step = now.join(second, F.col("dst") == F.col("via")).join(F.broadcast(table), ["k1", "k2"]).select("src", F.col("end").alias("dst"), "kind", "via").distinct()
        out = step.withColumn("hops", F.lit(n)) if out is None else out.unionByName(step.withColumn("hops", F.lit(n)))
        now = step.select("src", "dst", F.col("kind").alias("k1")).distinct()
    return out


#: Steps of a composition that one task of ``compose_counts`` takes, and edges that are few enough to go to every task.
STEPS, FEW = 4_000_000, 1_000_000


def _composed(first, second):
    """The set of kinds that a set of kinds makes with another; sets are bits in the order of KINDS."""
    bits = [[sum({1 << KINDS.index(COMPOSITION[a][j]) for i, a in enumerate(KINDS) if x >> i & 1 for j in range(4) if y >> j & 1}) for y in range(16)] for x in range(16)]
    return F.element_at(F.array(*[F.lit(c) for row in bits for c in row]), first * 16 + second + 1)


def compose_counts(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """(hops, kind, n, vias): what ``compose_edges`` holds, counted by hops and kind without making its rows.

    Through one ``via`` every source meets every end, so the two are counted apart, by the set of kinds that each
    has there, and the counts are multiplied. Only which nodes a source reaches is worked out: within the tasks
    that hold the source, one row a pair, and not at all after the last hop.
    """
    bit = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, 1 << i)]), F.col("kind"))
    reach = saved(edges.filter(F.col("kind").isin(*KINDS)).groupBy("src", "dst").agg(F.bit_or(bit).alias("m")), "composed")
    base = reach.select(F.col("src").alias("via"), F.col("dst").alias("end"), F.col("m").alias("m2"))
    leaving = saved(base.groupBy("via", "m2").agg(F.count("*").alias("ends")), "leaving")
    vias = leaving.select("via").distinct()
    inner = saved(base.join(vias.withColumnRenamed("via", "end"), "end", "left_semi"), "inner")
    few = inner.count() <= FEW
    out, arriving = None, saved(reach.groupBy(F.col("dst").alias("via"), F.col("m").alias("m1")).agg(F.count("*").alias("sources")), "arriving")
    for n in range(2, rounds + 2):
        met = arriving.join(leaving, "via").withColumn("m", _composed(F.col("m1"), F.col("m2"))).withColumn("n", F.col("sources") * F.col("ends"))
        each = met.select("via", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("m").bitwiseAND(1 << i).alias("on")) for i, k in enumerate(KINDS)])).alias("k"))
        each = each.filter("k.on <> 0").groupBy(F.col("k.kind").alias("kind"), "via").agg(F.sum("n").alias("n"))
        found = each.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("vias")).select(F.lit(n).alias("hops"), "kind", "n", "vias")
        out = found if out is None else out.unionByName(found)
        if n == rounds + 1:
            return out
        entering = inner.groupBy("via").agg(F.count("*").alias("k"))
        steps = arriving.join(entering, "via").agg(F.sum(F.col("sources") * F.col("k")).alias("s")).first().s or 0
        step = reach.select("src", F.col("dst").alias("via"), "m").join(vias, "via", "left_semi").repartition(max(1, -(-steps // STEPS)), "src")
        step = step.join(F.broadcast(inner) if few else inner, "via")
        step = step.groupBy("src", F.col("end").alias("dst")).agg(F.bit_or(_composed(F.col("m"), F.col("m2"))).alias("m"))
        if n < rounds:
            step = reach = saved(step, "composed")
        arriving = saved(step.groupBy(F.col("dst").alias("via"), F.col("m").alias("m1")).agg(F.count("*").alias("sources")), "arriving")
    return out
